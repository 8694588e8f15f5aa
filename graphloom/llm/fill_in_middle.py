"""Fill-in-middle transformation: whole batches of UTF-8 buffers are cut by one numpy kernel, without decoding a text.

Units are words with the white space before them, and white space at the end. A byte ends a unit if it is the last of its
document, or if it is no white space and the next is: a class looked up for every byte, and a mask of adjacent bytes. The
mask's running total, begun anew at each document, numbers the units; a binary search in it finds the cuts of all rows at once. The
parts of all rows are then one Arrow array over the same bytes, whose offsets are beginnings and cuts in turn.

Rows are independent, so nothing is shuffled. Batches are cut to ``CHUNK_BYTES`` of text (one longer text is a chunk by
itself, at some twelve bytes for each of its own). A null text is empty, an empty text is plain with n = 0. A null doc_id is
hashed as if its decimals were empty. Repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import prepare, table

SEED, RATE, SPM_RATE = 42, 50, 80
#: Marks of the parts: fixed values.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
CHUNK_BYTES = 4 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), 0x20]] = True
_STARTS = np.ones(256, bool)  # the byte begins a code point
_STARTS[0x80:0xC0] = False
_LETTER = np.zeros(256, bool)
_LETTER[[m[1] for m in (PREFIX, SUFFIX, MIDDLE)]] = True


def cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, first, second): units of each document, and where its prefix and its middle end in ``data``.

    Document i is data[offsets[i]:offsets[i + 1]], and the documents lie one behind the other from offset 0."""
    begin, end = offsets[:-1], offsets[1:]
    if not len(data):
        return np.zeros(len(begin), np.int64), begin, begin
    white = _WHITE[data]
    ends = np.empty(len(data), bool)
    ends[:-1] = ~white[:-1] & white[1:]
    ends[end[end > begin] - 1] = True
    total = np.cumsum(ends, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    before = np.where(begin > 0, total[begin - 1], 0).astype(np.int64)  # what the running total had at the document's beginning
    n = np.where(end > begin, total[end - 1], before) - before
    a, b = h1 % (n + 1), h2 % (n + 1)
    at = lambda k: np.where(k > 0, np.searchsorted(total, (before + k).astype(total.dtype), side="left") + 1, begin)
    return n, at(np.minimum(a, b)), at(np.maximum(a, b))


def marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents contain any of the marks."""
    at = np.flatnonzero((data[:-2] == 0x3C) & _LETTER[data[1:-1]] & (data[2:] == 0x3E)) if len(data) > 2 else np.zeros(0, np.int64)
    return np.searchsorted(at, offsets[1:] - 2) > np.searchsorted(at, offsets[:-1])


def _points(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points between the places of each row."""
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(_STARTS[data])))
    return total[end] - total[begin]


def _chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    at, last = 0, len(offsets) - 1
    while at < last:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(to, last)
        at = min(to, last)


def kernel(texts: pa.Array, h: list[np.ndarray], rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[pa.Array, ...]:
    """(n, form, prefix_chars, middle_chars, output) of an array of large strings without nulls; h has four hashes of each row."""
    rows = len(texts)
    _, where, what = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + rows + 1]
    data = np.frombuffer(what, np.uint8)[offsets[0] : offsets[-1]] if what is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n, first, second = cuts(data, offsets, h[0], h[1])
    plain = (offsets[1:] == offsets[:-1]) | marked(data, offsets) | (h[2] % 100 >= rate)
    spm = h[3] % 100 < spm_rate
    bounds = np.column_stack((offsets[:-1], first, second)).ravel()
    parts = pa.Array.from_buffers(pa.large_binary(), 3 * rows, [None, pa.py_buffer(np.append(bounds, offsets[-1]).tobytes()), pa.py_buffer(data)])
    prefix, middle, suffix = (parts.take(pa.array(np.arange(k, 3 * rows, 3))) for k in range(3))
    mark = lambda m: pa.scalar(m, pa.large_binary())
    joined = lambda *x: pc.binary_join_element_wise(*x, mark(b""))
    forms = np.where(plain, 0, np.where(spm, 1, 2))
    texts = texts.cast(pa.large_binary())
    as_psm = joined(mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle)
    as_spm = joined(mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle)
    output = pc.choose(pa.array(forms), texts, as_spm, as_psm)
    form = pa.array(["plain", "spm", "psm"]).take(pa.array(forms))
    sizes = [pa.array(_points(data, a, b), mask=plain) for a, b in ((offsets[:-1], first), (first, second))]
    return pa.array(n.astype(np.int64)), form, *sizes, output


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    ``rate`` of a hundred documents are rearranged, ``spm_rate`` of a hundred of these with the suffix first; which ones, and where they are
    cut, follows from the seed and the doc_id alone, so that a run may be repeated. The sizes are null where the form is plain."""
    prepare(docs.sparkSession)
    own = F.col(id_col).cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(own.cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    frame = docs.select(own.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            kind, texts = texts.type, texts.cast(pa.large_string())
            h = [b.column(f"h{k}").to_numpy() for k in range(4)]
            _, where, _ = texts.buffers()
            offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            for lo, hi in _chunks(offsets, CHUNK_BYTES):
                *found, output = kernel(texts[lo:hi], [x[lo:hi] for x in h], rate, spm_rate)
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], *found, output.cast(pa.large_string()).cast(kind)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return frame.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text of which ``output`` was made: the marks occur once each, as texts that hold one are left plain."""
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    body, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    front, back = (lambda mark: F.substring_index(body, mark, 1)), (lambda mark: F.substring_index(body, mark, -1))
    psm = F.concat(F.substring(front(s), len(p) + 1, 1 << 30), middle, back(s))
    spm = F.concat(back(p), middle, F.substring(front(p), len(s) + 1, 1 << 30))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark, sf_dir: str) -> DataFrame:
    found = transformed(table(spark, sf_dir, "documents"))
    whole = restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256"))


SQL = r"""
with hashed as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as x from documents),
    units as (select *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u,
        ('0x' || x[1:8])::bigint as h1, ('0x' || x[9:16])::bigint as h2, ('0x' || x[17:24])::bigint as h3, ('0x' || x[25:32])::bigint as h4 from hashed),
    cut as (select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b,
        text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 as plain from units),
    parts as (select *, array_to_string(u[1:a], '') as prefix, array_to_string(u[a + 1:b], '') as middle, array_to_string(u[b + 1:n], '') as suffix from cut),
    outputs as (select *, case when plain then text when h4 % 100 < 80 then '<S>' || suffix || '<P>' || prefix || '<M>' || middle
        else '<P>' || prefix || '<S>' || suffix || '<M>' || middle end as output from parts)
select doc_id, n::bigint as n, case when plain then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form,
    case when not plain then length(prefix)::bigint end as prefix_chars, case when not plain then length(middle)::bigint end as middle_chars,
    sha256(output) as output_sha256, sha256(text) as restored_sha256
from outputs
"""
