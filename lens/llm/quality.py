"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths, in numpy over whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lens.llm import common
from lens.llm.common import BLANK, U64, byte_set, mixed, plain, rows_of, small_batches, span_hashes, spans, table, utf8

#: n-gram length and the most of a text's word characters, in hundredths, that may be inside repeats of earlier n-grams. Lines
#: that repeat as a whole, such as license lines, count by LINE_LIMIT only.
NGRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: the most, in hundredths, of word characters that may be in lines equal to an earlier one
LINE_LIMIT = 20
MIN_WORDS = 50
MAX_REPEAT_WORDS = 50
SYMBOLS = byte_set(b"#*$%&|<>")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long, " + ", ".join(f"dup_chars_{n} long" for n in NGRAM_LIMITS)
_MARK = U64(0xD6E8FEB86659FD93)


def _counted(rows: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weight, n).astype(np.int64)[:n] if len(rows) else np.zeros(n, np.int64)


def _twice(keys: np.ndarray) -> np.ndarray:
    """Whether a key occurs twice or more."""
    order = np.sort(keys)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(again):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(again, keys)
    at[at == len(again)] = 0
    return again[at] == keys


def _later(keys: np.ndarray) -> np.ndarray:
    """Whether a key has occurred before."""
    order = np.argsort(keys, kind="stable")
    found = np.zeros(len(keys), bool)
    same = keys[order[1:]] == keys[order[:-1]]
    found[order[1:][same]] = True
    return found


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """The places that windows of n from these starts cover."""
    step = np.zeros(size + n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return np.cumsum(step)[:size] > 0


def measure(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """All figures of a batch of texts: its bytes, and where each text starts."""
    n = len(at) - 1
    heads = (data & 0xC0) != 0x80  # the first byte of each code point
    first, last = spans(~BLANK[data], at)
    doc = rows_of(first, at)
    points = np.concatenate([[0], np.cumsum(heads, dtype=np.int64)])
    chars = points[last] - points[first]
    out = {"n_words": _counted(doc, n), "word_chars": _counted(doc, n, chars)}
    out["n_symbols"] = _counted(rows_of(np.flatnonzero(SYMBOLS[data]), at), n)

    line = spans(data != 10, at)  # lines without a character have no word
    line_of_word = np.searchsorted(line[0], first, "right") - 1
    line_chars = _counted(line_of_word, len(line[0]), chars)
    has = np.flatnonzero(line_chars)
    line_doc = rows_of(line[0][has], at)
    again = _later(span_hashes(data, line[0][has], line[1][has]) + line_doc.astype(U64) * _MARK)
    out["n_dup_lines"] = _counted(line_doc[again], n)
    out["dup_line_chars"] = _counted(line_doc[again], n, line_chars[has[again]])
    fresh = np.ones(len(line[0]), bool)
    fresh[has[again]] = False

    # One running sum over the words; the hash of a window of any length is what it grows by there, moved to place 0.
    words, size = span_hashes(data, first, last), len(first)
    common._grown(size)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(words * common._powers[0][:size])])
    where = np.arange(size)
    for k in (3, *NGRAM_LIMITS):  # a repeated window begins with a repeated shorter one
        where = where[where + k <= size]
        where = where[doc[where] == doc[where + k - 1]]
        keys = mixed((sums[where + k] - sums[where]) * common._powers[1][where]) + doc[where].astype(U64) * _MARK
        twice = _twice(keys)
        where, keys = where[twice], keys[twice]
        if k == 3:
            out["n_repeat_words"] = _counted(doc[_covered(where, 3, size)], n)
        else:
            inside = _covered(where[_later(keys)], k, size) & (fresh[line_of_word] if size else True)
            out[f"dup_chars_{k}"] = _counted(doc[inside], n, chars[inside])
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_WORDS * out["n_words"])
    kept = ~out["base_failed"] & (100 * out["dup_line_chars"] <= LINE_LIMIT * out["word_chars"])
    for k, most in NGRAM_LIMITS.items():
        kept &= 100 * out[f"dup_chars_{k}"] <= most * out["word_chars"]
    out["kept"] = kept
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        figures = measure(*utf8(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(figures[x]) for x in names[1:]]], names)


def quality_rules(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text), in any number of partitions and without a shuffle.

    word_chars, n_symbols, n_dup_lines and n_repeat_words are the base figures; dup_line_chars and dup_chars_n count the
    characters of words inside lines, or n-grams of words outside such lines, that repeat an earlier one of the same text. kept is false for
    texts under 50 words, with over half their words in repeated 3-word windows, or with more characters in repeats than
    NGRAM_LIMITS and LINE_LIMIT allow. Null and empty texts have no words and aren't kept; a null doc_id stays null; equal
    rows each get a row; an empty table gives none; further columns are ignored.
    """
    small_batches(docs.sparkSession)
    return plain(docs, "doc_id", "text").mapInArrow(_rows, SCHEMA)


def rejecting(docs: DataFrame) -> DataFrame:
    """docs without the rows that quality_rules() rejects, all columns as they are."""
    small_batches(docs.sparkSession)
    text = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(measure(*utf8(batch.column(text)))["kept"]))

    return docs.mapInArrow(keep, docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _sql() -> str:
    grams = " ".join(
        f""", g{n} AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, {', '.join(f'lead_{j}' for j in range(n))} ORDER BY i) AS nth
            FROM (SELECT doc_id, i, w AS lead_0{''.join(f', lead(w, {j}) OVER (PARTITION BY doc_id ORDER BY i) AS lead_{j}' for j in range(1, n))} FROM words) t WHERE lead_{n - 1} IS NOT NULL)
        , c{n} AS (SELECT w.doc_id, CAST(sum(length(w.w)) FILTER (WHERE NOT w.again) AS BIGINT) AS chars FROM words w
            SEMI JOIN (SELECT doc_id, unnest(range(i, i + {n})) AS i FROM g{n} WHERE nth > 1) d ON w.doc_id = d.doc_id AND w.i = d.i GROUP BY w.doc_id)"""
        for n in NGRAM_LIMITS
    )
    figures = ", ".join(f"coalesce(c{n}.chars, 0) AS dup_chars_{n}" for n in NGRAM_LIMITS)
    joins = " ".join(f"LEFT JOIN c{n} ON c{n}.doc_id = b.doc_id" for n in NGRAM_LIMITS)
    limits = " AND ".join(f"100 * dup_chars_{n} <= {most} * word_chars" for n, most in NGRAM_LIMITS.items())
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    , split AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM docs)
    , lines AS (SELECT doc_id, line, ln, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS ws, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS nw,
            length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY ln) AS nth
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS ln FROM docs) t)
    , words AS (SELECT doc_id, w, again, row_number() OVER (PARTITION BY doc_id ORDER BY ln, k) AS i
        FROM (SELECT doc_id, ln, nth > 1 AS again, unnest(ws) AS w, unnest(range(1, nw + 1)) AS k FROM lines WHERE nw > 0) t)
    , dups AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_dup_lines, CAST(sum(chars) AS BIGINT) AS dup_line_chars FROM lines WHERE nw > 0 AND nth > 1 GROUP BY doc_id)
    , tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times
        FROM (SELECT doc_id, i, w AS a, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS b, lead(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM words) t WHERE c IS NOT NULL)
    , rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM tri WHERE times > 1) t GROUP BY doc_id)
    {grams}
    , base AS (SELECT d.doc_id, CAST(len(s.ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(d.text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
            CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM docs d JOIN split s ON d.doc_id = s.doc_id)
    , figures AS (SELECT b.*, coalesce(dups.n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(rep.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
            coalesce(dups.dup_line_chars, 0) AS dup_line_chars, {figures}
        FROM base b LEFT JOIN dups ON dups.doc_id = b.doc_id LEFT JOIN rep ON rep.doc_id = b.doc_id {joins})
    SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_WORDS} * n_words AS base_failed,
        NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_WORDS} * n_words) AND 100 * dup_line_chars <= {LINE_LIMIT} * word_chars AND {limits} AS kept
    FROM figures"""


QUERIES = {"op8_quality_rules": op8_quality_rules}
SQL = {"op8_quality_rules": _sql()}
