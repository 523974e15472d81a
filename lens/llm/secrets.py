"""Secret scans by an inverted index of trigrams, in DataFrame operations only.

Each rule's regex gives a Boolean query over trigrams. The index has a posting (trigram, document) for each trigram that
some query asks for. Postings are kept by document, as the bits of the trigrams it has, so that intersecting the posting
lists of a rule's trigrams is a test of bits, and no list of a frequent trigram is ever in one place. The rule's regex then
verifies the documents that are left.
Rules without mandatory trigrams, such as runs of hex digits, are tried on every document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lens.llm.common import plain, table
from lens.llm.trigrams import Query, grams_of, query_of


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str  # read alike by java.util.regex, RE2 and Python
    group: int  # a match counts if this group has at least
    least: int  # so many characters
    base: bool = False
    test: str = ""  # a cheaper regex that finds something in each text where the rule does, for scans of all texts


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
RULES = (
    Rule("assign", f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", "[0-9a-f]+", 0, 24, True, "[0-9a-f]{24}"),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    Rule("github", "gh[opsu]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", "xox[abps]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{1,1000}\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0, 40),  # a bound on the header keeps the search linear
)
REDACTED = "[SECRET]"
_WORD, _BLOCK = 60, 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _key() -> Column:
    """Joins a document to its postings; texts without an id go by a hash. Documents that share a key share candidates,
    which costs a verification and changes no result."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index: (gram, key) for each of these trigrams in each text; gram is its place in the list."""
    low = docs.select(_key().alias("key"), F.lower("text").alias("low")).where("low IS NOT NULL")
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(k)) for k, g in enumerate(grams)]))
    return low.select(F.explode(has).alias("gram"), "key")


def _holds(query: Query, place: dict[str, int]) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        word, bit = divmod(place[query], _WORD)
        return F.col(f"m{word}").bitwiseAND(F.lit(1 << bit).cast("long")) != 0
    parts = [_holds(p, place) for p in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules): for each rule with mandatory trigrams, the documents whose postings satisfy its query; the bits of
    rules say which rules. Postings are combined before they are shuffled, a row for each document at most."""
    queries = {k: query_of(r.regex) for k, r in enumerate(rules)}
    grams = sorted(set().union(*(grams_of(q) for q in queries.values())))
    place = {g: k for k, g in enumerate(grams)}
    words = range(-(-len(grams) // _WORD))
    bit = lambda w: F.bit_or(F.when(F.floor(F.col("gram") / _WORD) == w, F.expr(f"shiftleft(1L, CAST(gram % {_WORD} AS INT))")).otherwise(F.lit(0).cast("long")))
    merged = postings(docs, grams).groupBy("key").agg(*[bit(w).alias(f"m{w}") for w in words])
    which = F.lit(0).cast("long")
    for k, q in queries.items():
        if q is not True:
            which = which.bitwiseOR(F.when(_holds(q, place), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return merged.select("key", which.alias("rules")).where("rules != 0")


def _may_match(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row, text, rules_): the rows of docs as structs, so that no name of theirs clashes, and the rules to verify. Each text
    is shuffled once, rows are unique by key but for repeated ids, and the side that is hashed is the small one."""
    found = candidates(docs, rules).select(F.col("key").alias("key_"), F.col("rules").alias("rules_"))
    rows = docs.select(F.struct("*").alias("row"), _key().alias("key__"))
    joined = rows.join(found.hint("shuffle_hash"), F.col("key__") == F.col("key_"), "left")
    return joined.select("row", F.col("row")["text"].alias("text"), "rules_")


def _asked(k: int, rule: Rule, text: Column) -> Column:
    if query_of(rule.regex) is True:
        return text.rlike(rule.test or rule.regex)
    return F.coalesce(F.col("rules_"), F.lit(0).cast("long")).bitwiseAND(F.lit(1 << k).cast("long")) != 0


def _found(text: Column, k: int, rule: Rule) -> Column:
    """The matches that count, as (start, rule, end) in code points: sums of the lengths of matches and of what is between
    them, in blocks, so that no row takes steps by the square of its matches."""
    length = lambda x: F.length(x).cast("long")
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    parts = F.struct(
        F.transform(F.split(text, rule.regex, -1), length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), length).alias("size"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)), lambda x: F.length(x) >= rule.least).alias("ok"),
    )

    def placed(p: Column) -> Column:
        n = F.size(p["size"])
        both = F.zip_with(F.slice(p["gap"], 1, n), p["size"], lambda a, b: a + b)
        return let(both, lambda steps: let(_before(steps, n), lambda before: _spans(p, n, steps, before)))

    def _before(steps: Column, n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))))
        return let(blocks, lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))))

    def _spans(p: Column, n: Column, steps: Column, before: Column) -> Column:
        def one(i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            start = F.get(before, block) + total(F.slice(steps, block * _BLOCK + 1, i % _BLOCK)) + F.get(p["gap"], i)
            return F.struct(start.alias("start"), F.lit(k).alias("rule"), (start + F.get(p["size"], i)).alias("end"), F.get(p["ok"], i).alias("ok"))

        kept = F.filter(F.transform(F.sequence(F.lit(0), n - 1), one), lambda x: x["ok"])
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["rule"].alias("rule"), x["end"].alias("end")))

    return let(parts, lambda p: F.when(F.size(p["size"]) > 0, placed(p)).otherwise(F.array().cast(_SPANS)))


_SPANS = "array<struct<start:long,rule:int,end:long>>"


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, found) for each row of docs (doc_id, text): an array of (start, rule, end) in code points, in order.

    Null texts count as empty; texts with a null doc_id are scanned like others; equal rows each get a row; an empty table
    gives none; further columns are ignored.
    """
    rows = _may_match(plain(docs, "doc_id", "text"), rules).withColumn("doc_id", F.col("row")["doc_id"])
    text = F.coalesce("text", F.lit(""))
    each = [F.when(_asked(k, r, text), _found(text, k, r)).otherwise(F.array().cast(_SPANS)) for k, r in enumerate(rules)]
    return rows.select("doc_id", F.array_sort(F.concat(*each)).alias("found"))


def _rebuilt(least: int) -> Callable[[Column], Column]:
    """The text from its gaps and matches, with those that count replaced."""

    def text(p: Column) -> Column:
        shown = F.zip_with(p["all"], p["group"], lambda m, g: F.when(F.length(g) >= least, F.lit(REDACTED)).otherwise(m))
        return F.array_join(F.zip_with(p["gap"], shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return text


def redacting(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret in a text replaced by REDACTED, one rule after the other; other columns as they are, whatever their
    names. Null texts stay null and rows without a doc_id are treated like others; equal rows each stay; an empty table
    stays empty. A text takes time in proportion to its length."""
    rows = _may_match(docs, rules)
    for k, r in enumerate(rules):
        text = F.col("text")
        parts = F.struct(F.split(text, r.regex, -1).alias("gap"), F.regexp_extract_all(text, F.lit(r.regex), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(r.regex), F.lit(r.group)).alias("group"))
        rows = rows.withColumn("text", F.when(_asked(k, r, text), let(parts, _rebuilt(r.least))).otherwise(text))
    return rows.select(F.col("row").withField("text", F.col("text")).alias("row")).select("row.*")


def _joined(found: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["rule"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    base = [k for k, r in enumerate(RULES) if r.base]
    of = lambda k: F.size(F.filter("found", lambda x: x["rule"] == k)).cast("long")
    counts = [of(k).alias(f"n_{RULES[k].kind}") for k in base]
    sha = F.sha2(_joined(F.filter("found", lambda x: x["rule"] <= max(base)), RULES), 256).alias("base_sha256")
    return found.select("doc_id", *counts, sha, _joined(F.col("found"), RULES).alias("spans"))


def _sql() -> str:
    each = " UNION ALL ".join(
        f"""SELECT r, {k} AS rule, '{r.kind}' AS kind, list_sum(gap[1:i]) + coalesce(list_sum(size[1:i - 1]), 0) AS start, list_sum(gap[1:i]) + list_sum(size[1:i]) AS stop
        FROM (SELECT r, unnest(range(1, len(size) + 1)) AS i, gap, size, grp FROM (SELECT r, list_transform(string_split_regex(text, '{r.regex.replace("'", "''")}'), lambda x: length(x)) AS gap,
            list_transform(regexp_extract_all(text, '{r.regex.replace("'", "''")}'), lambda x: length(x)) AS size, list_transform(regexp_extract_all(text, '{r.regex.replace("'", "''")}', {r.group}), lambda x: length(x)) AS grp FROM d) t) t WHERE grp[i] >= {r.least}"""
        for k, r in enumerate(RULES)
    )
    base = max(k for k, r in enumerate(RULES) if r.base)
    counts = ", ".join(f"CAST(count(f.r) FILTER (WHERE rule = {k}) AS BIGINT) AS n_{r.kind}" for k, r in enumerate(RULES) if r.base)
    span = "kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rule"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)
    , f AS ({each})
    SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({span}) FILTER (WHERE rule <= {base}), '')) AS base_sha256, coalesce(string_agg({span}) FILTER (WHERE f.r IS NOT NULL), '') AS spans
    FROM d LEFT JOIN f ON d.r = f.r GROUP BY d.r, d.doc_id"""


QUERIES = {"op2_secret_scan": op2_secret_scan}
SQL = {"op2_secret_scan": _sql()}
