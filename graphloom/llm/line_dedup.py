"""Line dedup with DataFrame functions only: compressed per-document keep bitmaps.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; two 64-bit hashes stand
for it. Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents keep only
their lines in the largest doc_id that holds them.

The hashes are written once. They are range-partitioned, and within a range sorted by hash, then document and position,
and streamed: a hash's documents are numbered as they come, which tells how many there are and which is the
last, the one that keeps it. A hash with more lines than a tenth of an average partition is hot and
would make its range uneven: hot hashes, of which there are at most ten times as many as partitions whatever the
data, are counted with partial aggregation instead, and their verdict is broadcast. All other hashes have too few lines to need
splitting.

A null text is one empty line. A null doc_id is one document, the smallest. Rows that are equal in
doc_id and text get the same bitmap; rows of one doc_id with different texts count as one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower, cut, cut_counted, documents, partitions, table

MIN_CHARS, MIN_DOCS = 20, 3
#: A hash is counted apart if it has so many lines at least, and more than this share of an average partition.
HOT_LINES, HOT_SHARE = 1_000, 10
_WHITE = " \t\n\x0b\x0c\r"
_LEAST = -(1 << 63)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, n, doc_key, pos) of the lines with long keys of ``documents``; n is the doc_id, null as the smallest."""
    n = F.coalesce("doc_id", F.lit(_LEAST)).alias("n")
    lines = docs.select(n, "doc_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("n", "doc_key", "pos", F.btrim("line", F.lit(_WHITE)).alias("line")).where(F.char_length("line") >= min_chars)
    key = ascii_lower(F.col("line"))
    return keys.select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"), "n", "doc_key", "pos")


def dropped_lines(hashes: DataFrame, min_docs: int = MIN_DOCS, hot_lines: int = HOT_LINES) -> DataFrame:
    """(doc_key, pos) of the lines that go."""
    parts = partitions(hashes.sparkSession)
    hashes, n = cut_counted(hashes, "line-hashes")
    least = max(hot_lines, n // (HOT_SHARE * parts) + 1)
    # At most n / least hashes have so many lines: under HOT_SHARE * parts.
    hot = F.broadcast(cut(hashes.groupBy("h1").count().where(F.col("count") >= least).select("h1"), "hot"))

    cool = hashes.join(hot, "h1", "left_anti").repartitionByRange(parts, "h1")
    of_hash = Window.partitionBy("h1", "h2")
    numbered = cool.withColumn("nth", F.dense_rank().over(of_hash.orderBy("n")))
    judged = numbered.withColumn("docs", F.max("nth").over(of_hash))
    gone = judged.where((F.col("docs") >= min_docs) & (F.col("nth") < F.col("docs"))).select("doc_key", "pos")

    warm = hashes.join(hot, "h1")
    verdict = warm.select("h1", "h2", "n").distinct().groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("n").alias("keeper"))
    # One row for each h2 under the hot h1: as many as there are hot keys, but for collisions of 64-bit hashes.
    verdict = verdict.where(F.col("docs") >= min_docs).select("h1", "h2", "keeper")
    return gone.union(warm.join(F.broadcast(verdict), ["h1", "h2"]).where("n < keeper").select("doc_key", "pos"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hot_lines: int = HOT_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_key, keep): the bitmaps of documents that lose lines, without their texts.

    keep holds 64-line words as (word, bits), bit i for line 64 * word + i; words whose lines all stay are left out.
    """
    gone = dropped_lines(line_hashes(documents(docs, id_col, text_col), min_chars), min_docs, hot_lines)
    words = gone.groupBy("doc_key", F.expr("pos div 64").alias("word")).agg(F.expr("~bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    return words.groupBy("doc_key").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def _under(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """``documents`` with lines and those that stay."""
    d = documents(docs, id_col, text_col, carried).join(bitmaps, "doc_key", "left")
    d = d.withColumn("lines", F.split("text", "\n", -1))
    d = d.withColumn("words", F.expr("transform(sequence(0L, element_at(keep, -1).word), w -> coalesce(map_from_entries(keep)[w], -1L))"))
    stay = F.expr("filter(lines, (x, i) -> getbit(coalesce(get(words, cast(i div 64 as int)), -1L), i % 64) = 1)")
    return d.withColumn("stay", F.when(F.col("keep").isNull(), F.col("lines")).otherwise(stay))


def kept_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_key, n_lines, n_dropped, kept): the texts under their bitmaps."""
    counts = [F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("stay")).cast("long").alias("n_dropped")]
    return _under(docs, bitmaps, id_col, text_col).select("doc_id", "doc_key", *counts, F.array_join("stay", "\n").alias("kept"))


def deduplicated(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with the kept texts in place of theirs; their sizes in code points go to ``size_col``, if it is there."""
    names = tuple(docs.columns)
    kept = F.array_join("stay", "\n")
    new = {text_col: kept, size_col: F.char_length(kept).cast("long")}
    return _under(docs, bitmaps, id_col, text_col, names).select(*(new.get(c, F.col(f"_{i}")).alias(c) for i, c in enumerate(names)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = kept_lines(docs, keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


KEYED = r"""
    select doc_id, i as pos, lines[i] as line,
        translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from {docs}), unnest(range(1, len(lines) + 1)) as u(i)
"""
DROPS = """
    select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3
"""
SQL = f"""
with keyed as ({KEYED.format(docs="documents")}), drops as ({DROPS}),
    judged as (select k.doc_id, k.pos, k.line, coalesce(k.doc_id < d.keeper, false) as gone from keyed k left join drops d using (key))
select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""
