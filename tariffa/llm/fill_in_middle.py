"""Fill-in-the-middle with cuts between tokens, by a sparse index of multibyte characters.

A text is cut at two of its token borders into prefix, middle and suffix, which are written in another order behind
markers. The work is done on UTF-8 bytes. Of a text only its multibyte characters are recorded: their positions
and the bytes that each has more than one. A code-point position becomes a byte position, and back, by
one searchsorted over these exceptions; between two exceptions both positions advance alike, and a text without
exceptions has equal positions. So no array of offsets of all characters is ever built.

Tokens are runs of ASCII letters and single other characters. The numbers that choose cuts and form come from the
sha256 of a seed and the id, so a rerun of a lost task gives the same rows.

Defined results: a null text counts as empty; an empty text, or one that holds a marker, stays plain. A null id counts as
an empty one. Repeated rows return repeatedly. Columns of docs are kept; new ones take free names beside clashing ones.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tariffa.llm.common import free, table

#: Markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Parts of a hundred that stay plain from, and that take suffix first below.
PLAIN_FROM, SPM_BELOW, SEED = 90, 20, "1:"
STEP = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class ByteIndex:
    """Code-point and byte positions of a UTF-8 text, from its multibyte characters alone."""

    def __init__(self, data: np.ndarray):
        leads = [at + np.flatnonzero(data[at:at + STEP] >= 0xC0) for at in range(0, len(data), STEP)]
        self.bytes = np.concatenate(leads) if leads else np.zeros(0, np.int64)
        lead = data[self.bytes]
        self.excess = np.r_[0, np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))]
        self.points = self.bytes - self.excess[:-1]
        self.chars = len(data) - int(self.excess[-1])

    def to_byte(self, point: int) -> int:
        return int(point + self.excess[np.searchsorted(self.points, point)])

    def to_point(self, byte: int) -> int:
        """The position of the character that begins at this byte."""
        return int(byte - self.excess[np.searchsorted(self.bytes, byte)])


def token_starts(data: np.ndarray) -> np.ndarray:
    """Byte positions at which a token begins."""
    found = []
    for at in range(0, len(data), STEP):
        part = data[max(0, at - 1):at + STEP]
        letter = _LETTER[part]
        begins = (part & 0xC0) != 0x80
        begins[1:] &= ~(letter[1:] & letter[:-1])
        found.append(np.flatnonzero(begins[1:] if at else begins) + at)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Cut:
    """n tokens; the form; code points of prefix and middle (None if plain); the bytes written."""
    n: int
    form: str
    prefix: int | None
    middle: int | None
    output: bytes


def numbers(doc_id, seed: str = SEED) -> list[int]:
    digest = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]


def cut(text: bytes, doc_id, seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> Cut:
    data = np.frombuffer(text, np.uint8)
    starts = token_starts(data)
    n, (h1, h2, h3, h4) = len(starts), numbers(doc_id, seed)
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if not n or h3 % 100 >= plain_from or any(x in text for x in (p, s, m)):
        return Cut(n, "plain", None, None, text)
    index = ByteIndex(data)
    points = [index.chars if k == n else index.to_point(starts[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
    lo, hi = (index.to_byte(x) for x in points)
    prefix, middle, suffix = text[:lo], text[lo:hi], text[hi:]
    spm = h4 % 100 < spm_below
    parts = (s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle)
    return Cut(n, "spm" if spm else "psm", points[0], points[1] - points[0], b"".join(parts))


def transform(docs: DataFrame, seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> tuple[DataFrame, list[str]]:
    """All columns of docs with the tokens' number, form, code points of prefix and middle, and the text written; and
    the names that these five columns have."""
    names: list[str] = []
    typed = docs
    for c, kind in (("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")):
        names.append(free(typed, c))
        typed = typed.withColumn(names[-1], F.lit(None).cast(kind))
    key, at = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = b.column(at).cast(pa.binary())
            cuts = [cut(t.as_py() or b"", i.as_py(), seed, plain_from, spm_below) for t, i in zip(texts, b.column(key))]
            added = [pa.array([c.n for c in cuts], pa.int64()), pa.array([c.form for c in cuts], pa.string()),
                     *[pa.array([getattr(c, k) for c in cuts], pa.int64()) for k in ("prefix", "middle")],
                     pa.array([c.output for c in cuts], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], [*b.schema.names, *names])
    return docs.mapInArrow(run, typed.schema), names


def restored(output: Column, form: Column) -> Column:
    """The text before the transformation. No part of a cut text holds a marker, so each marker stands once."""
    first, last = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.lit(MIDDLE)
    a = F.substring_index(F.substring(output, 4, 2147483647), SUFFIX, 1)
    b = F.substring_index(F.substring(output, 4, 2147483647), PREFIX, 1)
    head = F.when(form == "psm", a).otherwise(b)
    rest = F.substring(output, F.length(head) + F.length(first) + 4, F.lit(2147483647))
    second = F.substring_index(rest, MIDDLE, 1)
    middle = F.substring(rest, F.length(second) + F.length(last) + 1, F.lit(2147483647))
    return (F.when(form == "psm", F.concat(head, middle, second)).when(form == "spm", F.concat(second, middle, head))
            .otherwise(output))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(cast(doc_id AS varchar), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents
), k AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM t
), f AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain'
      WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM k
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM f
"""
