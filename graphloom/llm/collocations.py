"""Phrase collocations: n-grams as DataFrame rows, hash-aggregated per language; DataFrame functions only.

All n-grams of 1 to ``max_words`` words are exploded into rows, one length after the other, and counted per language. Before its rows
are aggregated, a length leaves out those whose first or last n - 1 words were too rare, which no candidate and no part of one can be: parts
of a phrase are at least as frequent as the phrase. What was frequent is told by ``SLOTS`` hash slots, a broadcast whose size does
not grow with the data: a rare phrase in the slot of a frequent one is only counted in vain. What is left of two and three words is counted
by codes of 32 bits first, and then, where a code is frequent, by phrase; only counts of ``least`` or more are kept.

Counts of both sides of every cut are joined to the candidates, scores are exact (decimals of 38 digits, integral division: an
error is raised beyond them, none is rounded), and candidates that a phrase of one more word stands for are anti-joined. One word more is
enough: if any longer candidate holds the phrase as often, so does one between them. Ranks are taken in slices of each language
first, so that no task sorts a whole language.

A null text is empty, a null language is ``und``. Repeated rows count as often as they are there; ids and all other columns are not
read. An empty table, or one without frequent phrases, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower, cut, discard, table

LEAST, MAX_WORDS, SHARE, TOP = 100, 5, 100, 2_000
#: Hash slots that tell what was frequent, a power of two: at most so many longs are broadcast.
SLOTS = 1 << 20
#: Phrases of so many words are counted by code first; of longer ones, few pass the filter by their parts, and words are few and short.
CODED = (2, 3)
#: Bits of a code; the lowest and the highest twenty tell its slots.
CODE_BITS, SLOT_SHIFTS = 32, (0, 12)
#: Slices of a language that are ranked by themselves.
SLICES = 64
#: Words that a row of exploded pieces holds at most, beside those that its last phrases need.
PIECE_WORDS = 10_000


def pieces(docs: DataFrame, max_words: int = MAX_WORDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, words, own): the words of each piece. Long pieces come in parts: the first ``own`` words are a part's, and those after them,
    max_words - 1 at most, begin the next."""
    text, piece = F.coalesce(F.col(text_col), F.lit("")), F.col("piece")
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    d = docs.select(lang, F.explode(F.split(text, r"[.,;:!?\n-\r]+", -1)).alias("piece"))
    d = d.select("lang", F.btrim("piece", F.lit(" \t")).alias("piece")).where("piece <> ''")
    lower = F.when(F.lower(piece) == piece, piece).otherwise(ascii_lower(piece))
    # A single space needs no regular expression.
    one = ~F.contains(piece, F.lit("  ")) & ~F.contains(piece, F.lit("\t"))
    d = d.select("lang", F.when(one, F.split(lower, " ", -1)).otherwise(F.split(lower, "[ \t]+", -1)).alias("all"))
    starts = F.when(F.size("all") <= PIECE_WORDS, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / PIECE_WORDS).cast("int")))
    d = d.select("lang", "all", F.explode(starts).alias("at"))
    words = F.when(F.size("all") <= PIECE_WORDS, F.col("all")).otherwise(F.slice("all", F.col("at") * PIECE_WORDS + 1, F.lit(PIECE_WORDS + max_words - 1)))
    own = F.least(F.size("all") - F.col("at") * PIECE_WORDS, F.lit(PIECE_WORDS))
    return d.select("lang", words.alias("words"), own.cast("int").alias("own"))


def _phrases(found: DataFrame, n: int) -> DataFrame:
    """(lang, w1, ..., wn): each phrase of n words, a row for each time it occurs."""
    here = F.least(F.col("own"), F.size("words") - n + 1)
    shifted = [F.slice("words", k + 1, here) for k in range(n)]
    rows = found.where(F.size("words") >= n).select("lang", F.inline(F.arrays_zip(*(s.alias(f"w{k}") for k, s in enumerate(shifted, 1)))))
    return rows.toDF("lang", *(f"w{k}" for k in range(1, n + 1)))


def _slot(h: Column, shift: int) -> Column:
    return F.shiftright(h, shift).bitwiseAND(F.lit(SLOTS - 1))


def _slots(of: DataFrame, shift: int = 0) -> DataFrame:
    """The slots of a column of hashes, at most SLOTS of them whatever the data."""
    return F.broadcast(cut(of.select(_slot(F.col(of.columns[0]), shift).alias("slot")).distinct(), "slots"))


def _among(rows: DataFrame, h: Column, slots: DataFrame, shift: int = 0) -> DataFrame:
    """The rows whose hash may be one of those that ``slots`` were made of."""
    return rows.withColumn("slot", _slot(h, shift)).join(slots, "slot", "left_semi").drop("slot")


def frequent(found: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS) -> list[DataFrame]:
    """(lang, phrase, f) of the phrases of 1, 2, ... words that occur ``least`` times or more in ``pieces``.

    Of two and three words, codes of 32 bits are counted first, which are few bytes to shuffle; phrases themselves only where their code is
    frequent, which is looked at before their parts, as it leaves least. Others are counted at once."""
    out: list[DataFrame] = []
    for n in range(1, max_words + 1):
        rows, names = _phrases(found, n), [F.col(f"w{k}") for k in range(1, n + 1)]
        parts = []
        if n > 1:
            words = F.split("phrase", " ")
            known = _slots(out[-1].select(F.xxhash64("lang", *(words[k] for k in range(n - 1)))))
            parts = [(F.xxhash64("lang", *part), known) for part in (names[:-1], names[1:])]
        if n in CODED:
            code, likely = F.xxhash64("lang", *names).bitwiseAND(F.lit((1 << CODE_BITS) - 1)), rows
            for part in parts:
                likely = _among(likely, *part)
            codes = cut(likely.groupBy(code.alias("code")).agg(F.count("*").alias("f")).where(F.col("f") >= least).select("code"), "codes")
            for shift in SLOT_SHIFTS:
                rows = _among(rows, code, _slots(codes, shift), shift)
        for part in parts:
            rows = _among(rows, *part)
        counts = rows.select("lang", F.concat_ws(" ", *names).alias("phrase")).groupBy("lang", "phrase").agg(F.count("*").alias("f"))
        out.append(cut(counts.where(F.col("f") >= least), f"phrases-{n}"))
    return out


def _cut_scores(candidates: DataFrame, counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """The candidates (lang, phrase, m, a) with l, r, n and score of their lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice(words, F.col("k") + 1, F.col("m")), " ").alias("rest"))
    side = lambda part, name: counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    joined = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(sizes, "lang")
    score = F.expr("(cast(1000 * a as decimal(19,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(18,0)))")
    best = F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("best")
    return joined.groupBy("lang", "phrase", "a", "n").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def without_parts(candidates: DataFrame, share: int = SHARE) -> DataFrame:
    """Candidates (lang, phrase, m, a) but for those that lie inside another of one more word with ``share`` of a hundred of
    their occurrences or more."""
    words = F.split("phrase", " ")
    inner = F.explode(F.array(F.slice(words, F.lit(1), F.col("m") - 1), F.slice(words, F.lit(2), F.col("m") - 1)))
    longer = candidates.where("m > 2").select("lang", F.col("a").alias("by"), inner.alias("inner"))
    longer = longer.select("lang", "by", F.array_join("inner", " ").alias("phrase")).groupBy("lang", "phrase").agg(F.max("by").alias("by"))
    gone = (candidates["lang"] == longer["lang"]) & (candidates["phrase"] == longer["phrase"]) & (100 * longer["by"] >= share * candidates["a"])
    return candidates.join(longer, gone, "left_anti")


def collocations(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, share: int = SHARE, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    a, l and r: occurrences of the phrase and of both sides of its lowest-scoring cut; n: words of the language."""
    found = cut(pieces(docs, max_words, text_col, lang_col), "pieces")
    sizes = cut(found.groupBy("lang").agg(F.sum(F.col("own").cast("long")).alias("n")), "words")
    levels = frequent(found, least, max_words)
    discard(found)
    counts, candidates = levels[0].select("lang", "phrase", "f"), None
    for m, level in enumerate(levels[1:], 2):
        counts = counts.union(level)
        own = level.select("lang", "phrase", F.lit(m).alias("m"), F.col("f").alias("a"))
        candidates = own if candidates is None else candidates.union(own)
    scored = _cut_scores(without_parts(candidates, share), counts, sizes).withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    for group in (["lang", "slice"], ["lang"]):
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return scored.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
    split as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
    starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from split),
    grams as (select lang, unnest(range(1, 6)) as m, w, i from starts),
    f as (select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase, count(*) as f from grams where i + m - 1 <= len(w) group by all having count(*) >= 100),
    sizes as (select lang, sum(len(w)) as n from split group by lang),
    cand as (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from f where m >= 2),
    cuts as (select c.lang, phrase, a, m, k, array_to_string(w[1:k], ' ') as x, array_to_string(w[k + 1:m], ' ') as y from cand c, unnest(range(1, m)) as u(k)),
    scored as (select c.lang, c.phrase, a, p.f as l, q.f as r, s.n, k, (1000::hugeint * a * s.n) // (p.f::hugeint * q.f) as score
        from cuts c join f p on p.lang = c.lang and p.phrase = c.x join f q on q.lang = c.lang and q.phrase = c.y join sizes s on s.lang = c.lang),
    lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
    kept as (select * from lowest z where not exists (select 1 from cand c where c.lang = z.lang and len(string_split(z.phrase, ' ')) < c.m
        and contains(' ' || c.phrase || ' ', ' ' || z.phrase || ' ') and 100 * c.a >= 100 * z.a))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from kept qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
"""
