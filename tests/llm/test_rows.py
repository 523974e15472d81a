"""Operators that judge each text by itself, against plain versions."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lens.llm import decontaminate, pii
from lens.llm.common import utf8
from lens.llm.decontaminate import decontamination, removing
from lens.llm.pii import base_spans, find, fit, nodes_of, personal_data
from lens.llm.quality import quality_rules, rejecting
from lens.llm.secrets import RULES, redacting, secret_scan
from lens.llm.trigrams import grams_of, holds, query_of


def collected(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quality(docs, rows, nothing):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(docs).collect())

    def plain(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        times = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        inside = {k + j for k in range(len(w) - 2) if times[tuple(w[k : k + 3])] > 1 for j in range(3)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)

    assert got == Counter((i, *plain(t)) for i, t in rows)
    assert quality_rules(nothing).count() == 0
    kept = rejecting(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 3, 4, 11, None} and 15 not in {r.doc_id for r in kept.collect()}


def test_repetition_alone_rejects(spark, text_of):
    """Texts that the base figures let pass: what is inside repeated n-grams or lines decides, and one repeated line doesn't."""
    fresh = text_of(21, 400).split()
    passage, line = fresh[:30], " ".join(fresh[300:308])
    texts = {
        1: (" ".join(fresh[:300]), True),
        2: (" ".join(fresh[30:130] + passage + fresh[130:160] + passage), False),  # 30 of 190 words are in repeated n-grams
        3: (" ".join(fresh[30:290] + passage[:12] + fresh[290:330] + passage[:12]), True),  # 12 of 324
        4: ("\n".join([line, " ".join(fresh[:60]), line]), True),  # a license line, twice
        5: ("\n".join([line, " ".join(fresh[:40]), line, line]), False),  # 16 of 64 words
    }
    found = {r.doc_id: r for r in quality_rules(spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string")).collect()}
    assert not any(found[k].base_failed for k in texts)
    assert {k: found[k].kept for k in texts} == {k: kept for k, (_, kept) in texts.items()}
    for k, (text, _) in texts.items():
        lines, seen, again, words = text.split("\n"), set(), [], text.split()
        for x in lines:
            again += [x in seen] * len(x.split())
            seen.add(x)
        for n in (5, 6, 7, 8, 9, 10):
            grams, inside = set(), set()
            for i in range(len(words) - n + 1):
                if (g := tuple(words[i : i + n])) in grams:
                    inside |= set(range(i, i + n))
                grams.add(g)
            assert found[k][f"dup_chars_{n}"] == sum(len(words[i]) for i in inside if not again[i])


def test_decontamination(spark, docs, rows, nothing, monkeypatch):
    items = [(1, rows[0][1][300:500]), (2, "one two"), (3, None), (4, " .,! "), (None, rows[3][1]), (5, rows[3][1][:300]), (5, "alpha")]
    benchmark = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))

    want = []
    for doc_id, text in rows:
        w, hit, owners = words(text), set(), set()
        for item, t in items:
            x = words(t)
            n = min(13, len(x))
            wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n and item is not None else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    owners.add(str(item))
        want.append((doc_id, len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    assert collected(decontamination(docs, benchmark)) == sorted(want, key=repr)
    assert decontamination(nothing, benchmark).count() == 0 and not any(r.contaminated for r in decontamination(docs, nothing.withColumnRenamed("doc_id", "item_id")).collect())
    for most in (500,):  # several passes
        monkeypatch.setattr(decontaminate, "PASS_BYTES", most)
        assert collected(decontamination(docs, benchmark)) == sorted(want, key=repr)
        assert decontamination(nothing, benchmark).count() == 0 and removing(docs, benchmark).count() == sum(not x[5] for x in want)
    monkeypatch.undo()
    left = removing(docs, benchmark)
    assert left.columns == docs.columns and left.count() == sum(not x[5] for x in want)


def test_search_of_windows():
    """Any words against any items, also where blocks and windows repeat."""
    rng = random.Random(9)
    for _ in range(300):
        letters = "ab" if rng.random() < 0.5 else "abcdef"
        text_of_words = lambda n: " ".join(rng.choice(letters) for _ in range(n))  # noqa: B023, E731
        items = [(rng.randint(1, 4), text_of_words(rng.randint(0, 9))) for _ in range(4)]
        texts = [text_of_words(rng.randint(0, 40)) for _ in range(3)]
        data, at = utf8(pa.array(texts))
        n_words, hits = decontaminate.search(decontaminate.build(items, 5), data, at)
        for k, text in enumerate(texts):
            w, covered, owners = text.split(), set(), set()
            for item, t in items:
                x = t.split()
                n = min(5, len(x))
                for i in range(len(w) - n + 1 if n else 0):
                    if any(w[i : i + n] == x[j : j + n] for j in range(len(x) - n + 1)):
                        covered |= set(range(i, i + n))
                        owners.add(item)
            starts, ends, ids = hits.get(k, ([], [], set()))
            assert n_words[k] == len(w) and ids == owners and {p for a, b in zip(starts, ends, strict=True) for p in range(a, b)} == covered


def plain_secrets(text):
    out = []
    for k, r in enumerate(RULES):
        out += [(m.start(), k, m.end()) for m in re.finditer(r.regex, text or "") if len(m[r.group]) >= r.least]
    return sorted(out)


def test_secrets(docs, rows, nothing):
    got = sorted(((r.doc_id, [tuple(x) for x in r.found]) for r in secret_scan(docs).collect()), key=repr)
    assert got == sorted(((i, plain_secrets(t)) for i, t in rows), key=repr)
    assert secret_scan(nothing).count() == 0

    def hidden(text):
        for r in RULES:
            text = text if text is None else re.sub(r.regex, lambda m, r=r: "[SECRET]" if len(m[r.group]) >= r.least else m[0], text)
        return text

    shown = redacting(docs)
    assert shown.columns == docs.columns and sorted(((r.doc_id, r.text) for r in shown.collect()), key=repr) == sorted(((i, hidden(t)) for i, t in rows), key=repr)


def test_clashing_columns_and_empty_tables(spark, docs, nothing):
    names = ("key", "key_", "key__", "rules_", "rules", "row", "low", "gram", "hits", "items", "n_words", "id_", "kept", "again", "group", "node")
    more = docs.select("doc_id", "text", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    benchmark = spark.createDataFrame([(1, "alpha0 beta1")], "item_id long, text string")
    import corpus_pipeline

    for stage in (rejecting, redacting, lambda d: removing(d, benchmark), lambda d: corpus_pipeline.ngram_join(spark, d, "")):
        plain, wide = stage(docs.select("doc_id", "text")), stage(more)
        assert wide.columns == more.columns
        assert Counter((r[0], r[1]) for r in wide.collect()) == Counter(map(tuple, plain.collect()))
        assert {tuple(r[2:]) for r in wide.collect()} == {tuple(range(len(names)))}
        assert stage(nothing).collect() == [] and stage(nothing).columns == nothing.columns


def test_long_texts_of_near_tokens(spark):
    texts = ["eyJ" * 100_000 + " x.eyJ y", "token=" * 50_000, "0123456789abcde" * 20_000 + "g", "-----BEGIN " * 20_000]
    got = secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: [tuple(x) for x in r.found] for r in got} == {k: plain_secrets(t) for k, t in enumerate(texts)}


def test_many_secrets(spark):
    text = " ".join(f"token={k:06d}x " + "é" * (k % 5) for k in range(700))
    (row,) = secret_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(x) for x in row.found] == plain_secrets(text)


def test_trigram_queries():
    assert query_of("[0-9a-f]+") is True and query_of("AKIA[A-Z]+") == ("and", ("aki", "kia"))
    rng = random.Random(1)
    for r in RULES:
        query = query_of(r.regex)
        for _ in range(300):
            text = "".join(rng.choice(["password", "=", " ", "ab12cd", "AKIA", "api_key", "Token", ":", "ghp_", "xoxb-", "eyJ", ".", "-----BEGIN ", "PRIVATE KEY-----"]) for _ in range(8))
            if re.search(r.regex, text):
                assert holds(query, {g for g in grams_of(query) if g in text.lower()})


def plain_pii(text):
    def luhn(s):
        d = [int(c) for c in s if c in "0123456789"]
        return 14 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(reversed(d))) % 10 == 0

    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", luhn), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= sum(c in "0123456789" for c in s) <= 15),
    )
    return sorted((m.start(), k, m.end()) for k, (rx, ok) in enumerate(rules) for m in re.finditer(rx, text) if ok(m[0]))


def test_pii_patterns():
    rng = random.Random(2)
    for _ in range(5000):
        text = "".join(rng.choice("a1.@+- (25)0_é4") for _ in range(rng.randint(0, 40)))
        assert base_spans(text) == plain_pii(text), text


def test_pii(docs, rows, nothing):
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in personal_data(docs).collect()), key=repr)

    def plain(text):
        found = plain_pii(text or "")
        shown = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in found)
        return *(sum(x[1] == k for x in found) for k in range(4)), hashlib.sha256(shown.encode()).hexdigest()

    assert got == sorted(((i, *plain(t)) for i, t in rows), key=repr)
    assert personal_data(nothing).count() == 0


def field():
    """A model fitted on texts whose numbers aren't personal data unless a pattern says so."""
    samples = []
    for k in range(60):
        t = f"call +1 ({200 + k}) 555-{1000 + k} or card 4111 1111 1111 1111 at 10.0.{k}.1, 17 of {k} and no. {5550000 + k} of {k}-{k}, mail a{k}@example.com"
        places, features, linked, keys = nodes_of(t)
        samples.append((features, pii._labels(places, base_spans(t)), linked, keys))
    return fit(samples)


def enumerated(model, features, chain, skip):
    """Exact marginals: all labellings of a few nodes."""
    scores, n = pii._scores(model, np.array(features, np.int64)), len(pii.KINDS) + 1
    total = np.zeros((len(features), n))
    for ys in itertools.product(range(n), repeat=len(features)):
        p = np.exp(sum(scores[k, y] for k, y in enumerate(ys)) + sum(model["chain"][ys[a], ys[b]] for a, b in chain) + sum(model["skip"][ys[a], ys[b]] for a, b in skip))
        for k, y in enumerate(ys):
            total[k, y] += p
    return total / total.sum(1, keepdims=True)


def test_pii_marginals():
    rng = np.random.default_rng(4)
    for _ in range(20):
        model = {"node": rng.normal(size=(pii.N_FEATURES, 5)), "chain": rng.normal(size=(5, 5)), "skip": rng.normal(size=(5, 5))}
        edges = [(int(rng.integers(0, k)), k) for k in range(1, 5)]  # a tree, where message passing is exact
        chain, skip = edges[:2], edges[2:]
        features = rng.integers(0, 1 << pii.N_FEATURES, 5)
        got = pii.marginals(model, features, np.array(chain), np.array(skip))
        assert np.abs(got - enumerated(model, features, chain, skip)).max() < 1e-3


def test_pii_distant_mentions_decide():
    """A number that no pattern matches is found because a pattern has found it elsewhere; without skip links it isn't."""
    text = "write to +1 (212) 555-0147 today. " + "some words in between " * 40 + "again 555-0147 it is, not 555-0148 nor no. 9807915762804490"
    model = field()
    ((base, found),) = find(model, [text])
    again = text.rindex("555-0147")
    assert set(found) - set(base) == {(again, 3, again + 8)}
    for off in ({"skip": 0 * model["skip"]}, {"skip": 0 * model["skip"], "chain": 0 * model["chain"]}):
        assert find(model | off, [text])[0][1] == base
    for few in ("no. 5550147 and 555-0147", "4111-1111-1111-1112 or 17", "a@b"):  # shape alone never decides
        assert find(model, [few])[0][1] == base_spans(few)


def test_pii_spans(spark, docs, rows):
    """The query's spans are the base's, and the nodes outside them that exact marginals give a label."""
    model = field()
    texts = [(50 + k, t) for k, t in enumerate(("+1 (212) 555-0147 x 555-0147", "a@b.cd and 7@b or 7@b.cd", "1.2.3.4 x 1-2-3-4 y 1.2.3.4.5", "555-0147", None, ""))]
    got = {r.doc_id: r.spans for r in personal_data(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    for doc_id, text in texts:
        base, (places, features, linked, keys) = base_spans(text or ""), nodes_of(text or "")
        p = enumerated(model, pii._told(features, pii._labels(places, base)), [(k - 1, k) for k, x in enumerate(linked) if x], pii._pairs(keys))
        more = [(a, int(y.argmax()) - 1, b) for (a, b), y in zip(places, p, strict=True) if y.max() >= pii.SURE and y.argmax() and not any(a < d and b > c for c, _, d in base)]
        assert got[doc_id] == pii.written(sorted(base + more))
    assert got[50].count("phone") == 2
    whole = Counter((r.doc_id, r.spans) for r in personal_data(docs, model).collect())
    assert whole == Counter((i, pii.written(find(model, [t or ""])[0][1])) for i, t in rows)
