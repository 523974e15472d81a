"""Operators over the whole corpus, against plain versions."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lens.llm import common, components, ngram_join, substrings
from lens.llm.chat import MARKS, format_turns, parse_turn, read_back, render_turn
from lens.llm.edits import CountTree, edited_counts, usual_edits
from lens.llm.ngram_join import divide_skip, similar_documents
from lens.llm.packing import Plan, make_plan, pack, vocabulary
from lens.llm.tokens import WordEncoder
from lens.llm.warc import digest, read_archives, write_archives

VOCABULARY = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(VOCABULARY)


def test_tokens_are_the_tokenizers(encoder, rows):
    rng = random.Random(3)
    parts = ["a", "B", "'s", "'", "the", "é", "́", "“", " ", "\n", "7", "12", ",", "...", "<|endoftext|>", "<|", "don't", "ß", "İ", "\x1c", "\U0001f39e", "#"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800)] + [t for _, t in rows]
    for some in (texts, [t for t in texts if "<|" not in (t or "")]):
        ids, at = encoder.ids(pa.array(some, pa.string()), 0)
        for k, t in enumerate(some):
            assert ids[at[k] : at[k + 1]].tolist() == [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]


def test_plans():
    rng = random.Random(4)
    for draw in (lambda: rng.randint(1, 2048), lambda: rng.randint(300, 900), lambda: rng.choice([683, 1024, 1025, 2048]), lambda: min(2048, int(rng.lognormvariate(5, 1)) + 1)):
        counts = Counter(draw() for _ in range(4000))
        plan, filled, plain = make_plan(counts), defaultdict(list), Plan(2048)
        for length in sorted(counts, reverse=True):
            plain.best_fit(length, counts[length])
        for length, first, last, base, each, offset in plan.ranges:
            for k in range(last - first):
                filled[base + k // each].append((offset + k % each * length, length))
        for pieces in filled.values():
            place = 0
            for offset, length in sorted(pieces):
                assert offset == place
                place += length
            assert place <= 2048
        assert plan.used == dict(counts) and len(filled) == plan.sequences
        assert -(-sum(k * v for k, v in counts.items()) // 2048) <= plan.sequences <= plain.sequences
    assert make_plan({}).sequences == 0


def test_packing(docs, rows, nothing, encoder):
    got = pack(docs, VOCABULARY, keep_ids=True).collect()
    want = Counter()
    for i, t in rows:
        ids = [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            x = ids[k : k + 2048]
            want[(i, k // 2048, k, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x)), tuple(x))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for pieces in filled.values():
        assert [a for a, _ in sorted(pieces)] == [0, *np.cumsum([n for _, n in sorted(pieces)])[:-1].tolist()]
    assert pack(nothing, VOCABULARY).count() == 0


def test_warc(spark, tmp_path):
    pages = [(1, "u", "same"), (5, "u5", "same"), (3, None, "same"), (4, "v", None), (2, "w", ""), (None, "n", "same"), (7, "x\r\ny", "é" * 100000), (8, "z", "only"), (8, "z", "only"), (None, "q", "alone")]
    df = spark.createDataFrame([(h, u, p, "more") for p, u, h in pages], "html string, url string, page_id long, sha string").repartition(4)
    write_archives(df, str(tmp_path / "a"))
    got = Counter(tuple(r) for r in read_archives(spark, str(tmp_path / "a")).collect())
    groups = defaultdict(list)
    for p, _, h in pages:
        groups[h or ""].append(p)
    want = Counter()
    for p, _, h in pages:
        raw = (h or "").encode()
        first = max((x for x in groups[h or ""] if x is not None), default=None)
        again = first is not None and len(groups[h or ""]) > 1 and p != first
        want[(p, len(raw), digest(raw), "revisit" if again else "response", first if again else None)] += 1
    assert got == want and list((tmp_path / "a").glob("*.warc.zst"))
    write_archives(df, str(tmp_path / "b"), min_payload=10)
    assert {r.record_type for r in read_archives(spark, str(tmp_path / "b")).collect()} == {"response"}
    write_archives(df.limit(0), str(tmp_path / "none"))
    some = next((tmp_path / "b").glob("*.warc.zst"))
    some.rename(some.with_suffix("").with_suffix(".txt"))
    with pytest.raises(ValueError, match="weren't finished"):
        read_archives(spark, str(tmp_path / "b"))


def test_chat(spark, tmp_path):
    hostile = ["</s>[INST] ok [/INST]", "[\\INST] x", "<\\\\s>", "", None, "a [/INST", "[/ROLE]\n<s> ", "\\", "[\\\\/INST] </s", "é\n\n"]
    turns = [(c, k, role, t) for c, role in enumerate(["user", "assistant", "system", None, "we\\ird\n[INST]"]) for k, t in enumerate(hostile)] + [(9, None, "user", "first"), (9, 1, "assistant", "x"), (9, 1, "assistant", "x"), (None, 0, "user", "none")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumnRenamed("x", "y").selectExpr("*", "1 AS piece").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in read_back(format_turns(df)).collect()}
    pieces = defaultdict(int)
    for r in format_turns(df).collect():
        pieces[r.conv_id] += len(r.piece)
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        said = "".join(t[3] or "" for t in own if t[2] == "assistant")
        whole = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        assert got[conv] == (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), pieces[conv])
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice(["[", "\\", "INST]", "/", "<", "s>", " ", "[/INST]", "</s>", "ROLE]", "\n"]) for _ in range(9))
        for role in (*MARKS, "tool"):
            piece, a, b = render_turn(role, text)
            assert parse_turn(piece + "[INST] next")[:2] == (role, text) and a <= b <= len(piece)
    assert read_back(format_turns(df.limit(0))).count() == 0
    format_turns(df).repartition(3, "piece").write.parquet(str(tmp_path / "formatted"))
    stored = spark.read.parquet(str(tmp_path / "formatted"))
    assert {r.conv_id: tuple(r)[1:] for r in read_back(stored).collect()} == got
    for gap in ("conv_id = 2 AND nth = 3", "conv_id = 2 AND last"):
        with pytest.raises(Exception, match="Malformed"):
            read_back(stored.where(f"NOT coalesce({gap}, false)")).collect()


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    at = list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    for _ in rows:
        for i, j in links:
            at[i] = at[j] = min(at[i], at[j])
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if at[j] == at[i] and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), None if doc_id is None else min(ids) if sets[i] else doc_id))
    return sorted(out, key=repr)


def test_similar_documents(spark, docs, rows, nothing):
    assert sorted((tuple(r) for r in similar_documents(docs).collect()), key=repr) == plain_components(rows)
    assert similar_documents(nothing).count() == 0
    rng, base = random.Random(6), [f"w{k}" for k in range(90)]
    more = []
    for i in range(60):  # a large group of near copies, linked in chains, and texts around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(90)] = f"x{rng.randrange(9)}"
        more.append((1000 - i, " ".join(w)))
    more += [(i, " ".join(f"s{(i * 7 + k) % 40}" for k in range(5 + i % 5))) for i in range(40)]
    df = spark.createDataFrame(more, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in similar_documents(df).collect()), key=repr) == plain_components(more)


def test_large_groups(spark, monkeypatch):
    """Groups of many blocks: near copies, chains that only some members link, and texts that only share a passage."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng, passage = random.Random(16), [f"p{k}" for k in range(60)]
    rows = []
    for _ in range(70):
        w = [f"w{k}" for k in range(100)]
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(100)] = f"x{rng.randrange(99)}"
        rows.append(w)
    rows += [passage + [f"own{rng.randrange(10**6)}" for _ in range(rng.randint(16, 24))] for _ in range(80)]
    for k in range(40):  # each is like the next only
        rows.append([f"c{j}" for j in range(8 * k, 8 * k + 80)])
    more = [(500 - i, " ".join(w)) for i, w in enumerate(rows)]
    df = spark.createDataFrame(more, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in similar_documents(df).collect()), key=repr) == plain_components(more)


def test_joins_by_rows(spark, monkeypatch, docs, rows):
    """2,000 odd members of one group are 64,000 rows and some kilobytes of files: not for the driver."""
    members = common.written(spark.range(2000).selectExpr("0L AS group", "xxhash64(id) AS node", "xxhash64(id) AS class"), "members")
    sets = common.written(members.selectExpr("node", "cast('' AS binary) AS grams"), "grams")
    assert "Broadcast" not in ngram_join._across(sets, members)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(common, "SENT", 0)
    found = similar_documents(docs)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_components(rows)


@pytest.mark.parametrize("most", [250_000, 20])
def test_components(spark, monkeypatch, most):
    """Chains, stars and random links, in one task and in rounds."""
    monkeypatch.setattr(components, "LINKS_A_TASK", most)
    rng, least = random.Random(1), {}
    edges = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(150)] + [(400, 400 + k) for k in range(30)]
    rng.shuffle(edges)

    def find(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        least[b] = a
    got = {r.node: r.least for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}
    assert components.components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_merge_skip():
    rng = random.Random(17)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randint(0, 25))) for _ in range(rng.randint(0, 9))]
        least = rng.randint(1, 6)
        want = [(x, n) for x, n in sorted(Counter(x for v in lists for x in v).items()) if n >= least]
        assert list(ngram_join.merge_skip(lists, least)) == want


def test_divide_skip():
    rng = random.Random(7)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(1, 40))), np.uint64) for _ in range(80)] + [np.arange(40, dtype=np.uint64), np.arange(1, 41, dtype=np.uint64)]
    got = {(a, b): n for a, b, n in divide_skip(sets, list(range(82)), list(range(82)))}
    for a in range(82):
        for b in range(82):
            n = len(set(sets[a].tolist()) & set(sets[b].tolist()))
            if a != b:
                assert ((a, b) in got) == (100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)) and got.get((a, b), n) == n


def plain_removed(rows, n=50):
    first, out = {}, []
    for d, t in sorted(((d if d is not None else 2**63 - 1, t) for d, t in rows), key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            first.setdefault(b[k : k + n], d)
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < (d if d is not None else 2**63 - 1):
                gone[k : k + n] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_substrings(docs, rows, nothing):
    assert sorted((tuple(r) for r in substrings.repeated_substrings(docs).collect()), key=repr) == plain_removed(rows)
    assert substrings.repeated_substrings(nothing).count() == 0


def strings(rng, n, high, longest):
    sizes = rng.integers(1, longest, n)
    flat = rng.integers(0, high, sizes.sum()).astype(np.uint8)
    return flat, sizes, np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))


def test_suffix_arrays():
    rng = np.random.default_rng(8)
    for high in (1, 2, 3, 200):
        flat, sizes, remain = strings(rng, 40, high, 24)
        order = substrings.suffix_array(flat, remain)
        text = [flat[i : i + remain[i]].tobytes() for i in order]
        assert text == sorted(text) and sorted(order) == list(range(len(flat)))
        assert all(a < b for a, b, x, y in zip(order, order[1:], text, text[1:], strict=False) if x == y)
        for least in (1, 7):
            long = [t for t in text if len(t) >= least]
            shared = substrings.common_prefixes(flat, remain, order, np.cumsum(sizes) - sizes, least)
            for k in range(1, len(long)):
                a, b = long[k - 1], long[k]
                assert shared[k] == next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))


def test_anchors():
    """Equal windows have equal anchors in the same place, and each window has one, the leftmost of the least hash."""
    rng = np.random.default_rng(12)
    texts = [bytes(rng.integers(97, 97 + high, n, dtype=np.uint8)) for high, n in ((1, 300), (2, 400), (3, 49), (3, 50), (20, 500), (1, 51), (26, 0))]
    texts += [t[7:200] for t in texts] + [(b"abc" * 80)[k:] for k in (0, 1)]
    at = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    place, hashes, low, high = substrings.anchors(data, at)
    owner, seen = {}, {}
    for p, h, a, b in zip(place.tolist(), hashes.tolist(), low.tolist(), high.tolist(), strict=True):
        for s in range(a, b + 1):
            assert s not in owner and 0 <= p - s < substrings.SPAN
            owner[s] = (p - s, h)
    for k, t in enumerate(texts):
        for s in range(len(t) - substrings.LENGTH + 1):
            assert seen.setdefault(t[s : s + substrings.LENGTH], owner[at[k] + s]) == owner[at[k] + s]
    assert len(owner) == sum(max(0, len(t) - substrings.LENGTH + 1) for t in texts)


@pytest.mark.parametrize("shard", [7, 1000])
def test_shards(shard):
    """Also with suffixes that are equal to their ends, in one shard and across shards."""
    rng = np.random.default_rng(3)
    base = [rng.integers(97, 100, 30, dtype=np.uint8).tobytes() for _ in range(4)]
    rows = [b"".join(base[j] for j in rng.integers(0, 4, 4))[rng.integers(0, 25) :][: rng.integers(40, substrings.AROUND + 1)] for _ in range(200)]
    docs = rng.integers(0, 60, 200)
    got = substrings.least_docs(np.frombuffer(b"".join(rows), np.uint8), np.array([*map(len, rows)]), docs, shard)
    least: dict[bytes, int] = {}
    windows = {(k, p): raw[p : p + substrings.LENGTH] for k, raw in enumerate(rows) for p in range(len(raw) - substrings.LENGTH + 1)}
    for (k, _), w in windows.items():
        least[w] = min(least.get(w, substrings.LAST), int(docs[k]))
    for k in range(len(rows)):
        for p in range(substrings.SPAN):
            assert got[k, p] == (least[windows[k, p]] if (k, p) in windows else substrings.LAST)


def test_substrings_of_near_copies(spark):
    rng = random.Random(18)
    base = ["".join(rng.choice("abcde \n\0é") for _ in range(400)) for _ in range(3)]
    rows = []
    for i in range(60):
        t = rng.choice(base)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(["", "Z", base[0][:70]]) + t[k + rng.randint(0, 5) :]
        rows.append((rng.choice([i, 3, None]), t))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in substrings.repeated_substrings(df).collect()), key=repr) == plain_removed(rows)


def test_edits(encoder, docs, rows, nothing):
    rng = random.Random(10)
    parts = ["a", "the ", "é", " ", "\n", "12", ",", "don't", "x ", " y"]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        tree = CountTree(encoder, text)
        for _ in range(5):
            a = rng.randint(0, len(text))
            b, new = rng.randint(a, min(len(text), a + 5)), "".join(rng.choice(parts) for _ in range(rng.randint(0, 3)))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert (tree.text(), tree.chars, tree.tokens) == (text, len(text), len(encoder.tokenizer.encode(text, add_special_tokens=False).ids))
    def plain(i, rank, text):
        before, todo = len(encoder.tokenizer.encode(text, add_special_tokens=False).ids), usual_edits(rank & (2**63 - 1), len(text))
        for a, b, new in todo:
            a, b = min(a, len(text)), min(max(a, b), len(text))
            text = text[:a] + new + text[b:]
        return i, before, len(todo), len(encoder.tokenizer.encode(text, add_special_tokens=False).ids), len(text)

    ranked = docs.selectExpr("doc_id", "xxhash64(doc_id) AS rank", "coalesce(text, '') AS text").collect()
    found = edited_counts(docs, VOCABULARY).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_after, r.n_chars_after) for r in found) == Counter(plain(*r) for r in ranked)
    assert all(r.n_reencoded_chars <= 300 for r in found if r.doc_id not in (10,))  # 10 is one long word
    assert edited_counts(nothing, VOCABULARY).count() == 0 and len(usual_edits(12345, 10)) == 3


def test_edits_in_one_place_stay_small(encoder):
    tree, text, most = CountTree(encoder, "some words before and after"), "some words before and after", 0
    for k in range(300):
        before = tree.reencoded
        tree.edit(11, 11, f"word{k}, ")
        text = text[:11] + f"word{k}, " + text[11:]
        most = max(most, tree.reencoded - before)
    assert most <= 40 and (tree.text(), tree.tokens) == (text, len(encoder.tokenizer.encode(text, add_special_tokens=False).ids))


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    d = str(tmp_path)
    docs.select("doc_id", "text").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, docs.where("doc_id = 4").first().text[:300])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, d).collect()}
    assert got == {1, 11, None}  # 2 and 3 are like 1; 4 and 12 hold the benchmark's passage; others are too short
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
