"""Each operator against a brute-force version on a small fixture with every odd case, and on an empty table."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from llm_fixtures import docs, no_docs  # noqa: F401

from fidspark.llm import exact_dedup, license_scan, line_dedup, mixing, packing, pii, quality_classifier, quality_rules, simhash, warc
from fidspark.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rows_of = lambda df: [(r["doc_id"], r["text"] or "") for r in df.collect()]


# ---------------------------------------------------------------- exact dedup
def brute_copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", t), []).append((-len(t), i is None, i or 0))
    out = Counter()
    for norm, members in groups.items():
        first = min(members)
        for k, m in enumerate(sorted(members)):
            out[(None if m[1] else m[2], None if first[1] else first[2], len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("block,key", [(16384, F.xxhash64), (7, F.xxhash64), (7, lambda b: F.length(b).cast("long") * 0)])
def test_exact_dedup(docs, block, key):
    got = exact_dedup.exact_dedup(docs, block, key)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == brute_copies(rows_of(docs))


def test_exact_dedup_empty(no_docs):
    assert exact_dedup.exact_dedup(no_docs).collect() == []
    assert exact_dedup.drop_copies(no_docs).columns == no_docs.columns


# ---------------------------------------------------------------- quality rules
def brute_stats(t):
    w = WORD.findall(t)
    grams = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    often, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if often[g] > 1:
            covered.update(range(k, k + 5))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs):
    judged = quality_rules.judge(docs.withColumn("body", F.col("text"))).collect()
    assert len(judged) == docs.count()
    for r in judged:
        s = r.stats
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == brute_stats(r.body or "")
        failed = s.n_words < 10 or 100 * s.n_repeat_words > 20 * s.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_vote_model_finds_the_bad_class():
    rng = np.random.default_rng(0)
    bad = rng.uniform(size=4000) < 0.15
    votes = np.where(rng.uniform(size=(4000, 6)) < np.where(bad[:, None], 0.6, 0.02), -1, 1)
    votes[rng.uniform(size=votes.shape) < 0.2] = 0
    m = quality_rules.fit_votes(sorted(Counter(map(tuple, votes.tolist())).items()))
    odds = np.log(m["bad"] / (1 - m["bad"])) + sum(np.vectorize(lambda v, j=j: m["odds"][j].get(v, 0.0))(votes[:, j]) for j in range(6))
    truth = np.log(0.15 / 0.85) + ((votes < 0) * np.log(0.6 / 0.02) + (votes > 0) * np.log(0.4 / 0.98)).sum(1)
    assert ((odds > 0) == bad).mean() > ((truth > 0) == bad).mean() - 0.02


@pytest.mark.parametrize("n,share", [(4000, 0.3), (4000, 0.6), (200_000, 0.05), (200_000, 0.3), (200_000, 0.6)])
def test_vote_model_recovers_planted_rates(n, share):
    rng = np.random.default_rng(int(100 * share))
    bad = rng.uniform(size=n) < share
    sens, spec = np.array([0.7, 0.6, 0.8, 0.7, 0.65, 0.75]), np.array([0.85, 0.9, 0.95, 0.85, 0.8, 0.9])
    votes = np.where(rng.uniform(size=(n, 6)) < np.where(bad[:, None], sens, 1 - spec), -1, 1)
    votes[rng.uniform(size=votes.shape) < 0.1] = 0
    m = quality_rules.fit_votes(sorted(Counter(map(tuple, votes.tolist())).items()))
    assert abs(m["bad"] - share) < 0.05
    assert np.abs(np.array(m["sensitivity"]) - sens).max() < 0.05 and np.abs(np.array(m["specificity"]) - spec).max() < 0.05


def test_posterior_follows_bayes(spark):
    """The column expressions give what the fitted rates and Bayes' rule give for each document, and kept follows."""
    texts = ["word " * 30, "The quick brown fox jumps over lazy dogs near the old river bank today. " * 2 + "End.", "### $$$ !!! " * 20, "12 345 6789 " * 15,
             "\n".join(f"Line number {i} says another thing that nobody said before now" for i in range(12)), "A B C D E F G H I J K L"] * 7
    judged = quality_rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    m = quality_rules.fit_votes(sorted(Counter(tuple(r.votes) for r in judged).items()))
    for r in judged:
        good, bad = 1 - m["bad"], m["bad"]
        for v, sens, spec in zip(r.votes, m["sensitivity"], m["specificity"]):
            good *= {1: spec, 0: 1, -1: 1 - spec}[v]
            bad *= {1: 1 - sens, 0: 1, -1: sens}[v]
        assert r.posterior == pytest.approx(good / (good + bad), abs=1e-9)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_quality_rules_empty(no_docs):
    assert quality_rules.judge(no_docs).collect() == []


# ---------------------------------------------------------------- simhash
def brute_fingerprint(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    grams = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    counts = [sum(xxhash.xxh64_intdigest(g.encode(), seed=42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def brute_components(points, bits):
    roots = list(range(len(points)))

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= bits).tolist():
            a, b = find(i), find(j)
            roots[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def test_simhash(docs):
    got = simhash.classes(docs).select("doc_id", simhash.hex_fingerprint().alias("f"), "component_id").collect()
    rows = rows_of(docs)
    assert Counter((r.doc_id, r.f) for r in got) == Counter((i, f"{brute_fingerprint(t):016x}") for i, t in rows)
    points = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    roots = brute_components(points, 3)
    least = {}
    for (i, _), k in zip(rows, roots):
        least[k] = min(x for x in (least.get(k), i) if x is not None) if (least.get(k) is not None or i is not None) else None
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, least[k]) for (i, _), k in zip(rows, roots))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))


def test_vantage_trees_lose_no_link(spark):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = [int(s) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for s in seeds[:120] for k in (1, 2, 3, 4, 5)]
    chain = [int(seeds[0]) ^ ((1 << k) - 1) for k in range(0, 64, 3)]
    points = np.unique(np.concatenate((seeds, np.array(near + chain, np.uint64))))
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, shard_least=64, shard_most=64)).collect()}
    roots = brute_components(points, 3)
    ours = {int(p): got.get(int(p), int(p)) for p in points.view(np.int64)}
    groups = lambda keys: sorted(sorted(np.flatnonzero(np.array(keys) == k).tolist()) for k in set(keys))
    assert groups([ours[int(p)] for p in points.view(np.int64)]) == groups(roots)


def test_simhash_empty(no_docs):
    assert simhash.classes(no_docs).collect() == []


# ---------------------------------------------------------------- mixing
def test_mixing(docs):
    rows = mixing.draws(docs.withColumn("_keep", F.col("text")), block_words=50, shard_words=4000).collect()
    assert len(rows) == docs.count()
    again = mixing.draws(docs, block_words=50, shard_words=4000).collect()
    key = lambda rs: Counter((r.doc_id, r.source, r["size"], tuple((d.shard, d.words) for d in r.drawn)) for r in rs)
    assert key(rows) == key(again)
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(WORD.findall(r._keep or ""))
        t = sum(d.words for d in r.drawn)
        assert t <= 2 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += t
        target[r.source] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert target == pytest.approx(mixing.targets(list(sizes.items())))
    for s in sizes:
        assert target[s] <= 2 * sizes[s] + 1e-9 and abs(taken[s] - target[s]) <= 0.5
    mixed = mixing.mix(docs, block_words=50, shard_words=4000)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(t)) for _, t in rows_of(mixed)) == sum(taken.values())


def test_equal_rows_meet_the_target_to_the_word(spark):
    rows = [(1, "a", "one two three four five")] * 1000 + [(i, "b", "w " * (i % 9)) for i in range(2, 300)] + [(7, None, "x y")] * 40 + [(8, "c", "")] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    for block_words in (50, 1 << 16):
        got = mixing.draws(df, block_words=block_words).collect()
        assert len(got) == len(rows)
        for s in ("a", "b", None):
            own = [r for r in got if r.source == s]
            taken = [sum(d.words for d in r.drawn) for r in own]
            assert abs(sum(taken) - own[0].target) <= 0.5
            assert all(t <= 2 * r["size"] for t, r in zip(taken, own))
            # one row of the source is cut
            assert sum(t % r["size"] != 0 for t, r in zip(taken, own) if r["size"]) <= 1


def test_splitting_tree_keeps_quotas():
    got = mixing.split_quotas([100, 7, 0, 1], 5)
    assert got == mixing.split_quotas([100, 7, 0, 1], 5)
    assert [sum(k for _, s, k in got if s == i) for i in range(4)] == [100, 7, 0, 1]
    per_shard = [sum(k for h, _, k in got if h == j) for j in range(5)]
    assert max(per_shard) - min(per_shard) <= 3


def test_targets_reshare_the_excess():
    t = mixing.targets([("b", 10), (None, 100), ("a", 1000)])
    assert t["b"] == 20 and t[None] == 200 and t["a"] == pytest.approx(1445)


def test_mixing_empty(no_docs):
    assert mixing.draws(no_docs).collect() == [] and mixing.mix(no_docs).collect() == []


# ---------------------------------------------------------------- packing
def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(docs, tokenizer_path(), with_ids=True).collect()
    want = Counter()
    for i, text in rows_of(docs):
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [0], "<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a:a + 2048].tobytes()
            want[(i, k, a, len(part) // 4, zlib.crc32(part), part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and p[-1][0] + p[-1][1] <= 2048


def test_ids_are_those_of_any_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["Hello  World, it's 12 o'clock", "", " \n\ttabs\u00a0and e\u0301 ÀÉ", "<|endoftext|> x<|startoftext|>", "naïve—dash… 中文 \u2003wide", "I'LL go\x0bnow\x0c!"] * 3
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        own = Tokenizer.from_file(path)
        assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode(texts, path)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_is_tight():
    rng = np.random.default_rng(3)
    lengths = np.concatenate((rng.integers(1, 2049, 3000), rng.integers(1, 200, 6000)))
    seq, offset = packing.pack_lengths(lengths)
    assert seq.max() + 1 <= 1.01 * max(-(-lengths.sum() // 2048), (2 * lengths > 2048).sum())
    pairs = np.array([1024, 1024, 700, 1300, 2048, 683, 683])
    assert packing.pack_lengths(pairs)[0].max() + 1 == 4


def test_packing_empty(no_docs):
    assert packing.pack(no_docs, tokenizer_path()).collect() == []


# ---------------------------------------------------------------- WARC
def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/ b\r\nX: y", "same"), (2, None, "same"), (3, "http://c", "same"), (4, "http://d", ""), (5, "http://e", None), (None, "n", "same"),
             (6, "ü", "päge " * 5000), (6, "ü", "päge " * 5000), (7, "u", "x" * 100)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, payload string")
    files = []
    for k in range(2):
        folder = str(tmp_path / f"w{k}")
        manifest = warc.write_warc(df.repartition(k + 1), folder, shard_bytes=200, roll_bytes=300).collect()
        files.append(sorted((r.file, r.sha256, r.records) for r in manifest))
        got = warc.read_warc(spark, folder, payloads=True).collect()
        want = Counter()
        for i, _, h in pages:
            same = [p[0] for p in pages if (p[2] or "") == (h or "") and p[0] is not None]
            again = bool(same) and i != max(same)
            b = (h or "").encode()
            want[(i, len(b), warc.digest(b), "revisit" if again else "response", max(same) if again else None, None if again else b)] += 1
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload else r.payload and b"" if r.payload is None else b"")
                       for r in got) == want
    assert files[0] == files[1]  # same bytes under the same names, however the input is dealt
    none = warc.write_warc(df.limit(0), str(tmp_path / "none"))
    assert none.count() == 0 and warc.read_warc(spark, str(tmp_path / "none")).count() == 0


# ---------------------------------------------------------------- PII
KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(x):
    d = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(x))]
    return sum(v - 9 if v > 9 else v for v in d) % 10 == 0


def brute_spans(t):
    digits = lambda v: re.sub("[^0-9]", "", v)
    good = {"email": lambda v: True, "ip": lambda v: all(int(p) <= 255 for p in v.split(".")), "card": lambda v: 12 <= len(digits(v)) <= 19 and luhn(digits(v)),
            "phone": lambda v: 9 <= len(digits(v)) <= 15}
    found = sorted((m.start(), k, m.end()) for k, (n, p) in enumerate(KINDS) for m in re.finditer(p, t) if good[n](m[0]))
    return ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in found)


def test_pii_patterns(spark, docs):
    odd = ["a@b.com_x@y.org", "a@b@c.com", "1.2.3.4.5", "256.1.1.1 0255.001.1.1", "+1 (234) 567-8901.", "4111111111111111 4111 1111 1111 1112", "é😀 x@é.com x@y.zé +123456789",
           "1" * 3000 + ".2.3.4", "a" * 20000, "a.b" * 5000 + "@c.d", "--@-.-", "4111-1111-1111-1111 5", "x@y.z1.2.3.4", "00000000000000 +0000000000"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = pii.find(df).select("doc_id", pii.listed(F.col("base")).alias("b")).collect()
    assert Counter((r.doc_id, r.b) for r in got) == Counter((i, brute_spans(t)) for i, t in rows_of(df))


def test_pii_terms_that_give_an_entity_away(spark, no_docs):
    rows = [(i, f"line {chr(97 + i) * 4} note\nplease ask Zebulon about {chr(103 + i) * 3} at z@q.example.org soon") for i in range(4)]
    rows += [(10 + i, f"please ask about the {chr(97 + i % 26) * 5} soon at noon, said {chr(97 + i // 26) * 4}") for i in range(300)]
    rows += [(400, "Zebulon was here, please.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find(df).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    for i in range(4):
        at = rows[i][1].index("Zebulon")
        assert f"removed:{at}:{at + 7}" in got[i] or f"generalised:{at}:{at + 7}" in got[i]
        assert "email:" in got[i] and ":please" not in got[i]
    assert all(not got[10 + i] for i in range(300)) and not got[400]
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "[EMAIL]" in clean[0] and "Zebulon" not in clean[0] and clean[400] == rows[-1][1] and "please ask" in clean[0]
    assert pii.find(no_docs).collect() == [] and pii.sanitise(no_docs).columns == no_docs.columns


def test_pii_terms_on_neighbouring_lines_and_far_along_a_line(spark):
    rows = [(i, f"kept {chr(97 + i) * 5}\nfirst {chr(97 + i) * 4}\nZebulon\n \nz@q.example.org") for i in range(4)]
    rows += [(10 + i, f"Quorra said on that day of the week to {chr(97 + i) * 6}: y@q.example.org") for i in range(4)]
    rows += [(100 + i, f"kept said first on that day of the week to {chr(97 + i % 26) * 3} {chr(97 + i // 26) * 7}") for i in range(300)]
    found = {(r.entity, r.term) for r in pii.disclosing_terms(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {("email:z@q.example.org", "zebulon"), ("email:y@q.example.org", "quorra")}


def test_pii_terms_may_hold_digits_and_be_short(spark):
    rows = [(i, f"said {chr(97 + i) * 4}: EMP-1234 (jdoe42) Li 王伟 at z@q.example.org +44 20 7946 0958 for {chr(97 + i) * 6}") for i in range(4)]
    rows += [(100 + i, f"said {chr(97 + i % 26) * 3} at {chr(97 + i // 26) * 7} for 20") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all(clean[i].split() == f"said {chr(97 + i) * 4}: () at [EMAIL] [PHONE] for {chr(97 + i) * 6}".split() for i in range(4))
    assert all(clean[i] == t for i, t in rows[4:])


# ---------------------------------------------------------------- quality classifier
def test_classifier(spark, docs, no_docs):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_classifier.score_documents(d, labels)
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    again = quality_classifier.score_documents(d, labels).collect()
    assert {r.doc_id: r.score for r in got.collect()} == {r.doc_id: r.score for r in again}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in again)
    odd = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 0), (3, None, 0), (10, 0, 0)], "doc_id long, quality int, toxic int")
    scored = quality_classifier.score_documents(docs, odd).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in quality_classifier.score_documents(docs, odd.limit(0)).collect()} == {0.5}
    assert quality_classifier.score_documents(no_docs, labels).collect() == []


def test_isotonic_pools():
    x, y = quality_classifier.isotonic([(0.0, 0, 2), (0.2, 2, 2), (0.4, 0, 2), (0.9, 2, 2)])
    assert y.tolist() == [0, 0.5, 1] and np.allclose(x, [0, 0.3, 0.9])


# ---------------------------------------------------------------- line dedup
def test_line_dedup(spark, docs, no_docs):
    passage = " ".join(f"word{chr(97 + k % 26)}{'x' * (k // 26)}" for k in range(60))
    own = [" ".join(chr(97 + i) * k for k in range(2, 9)) for i in range(5)]
    rows = [(i, f"{own[i]}\nOrder 10{i} shipped to {chr(97 + i) * 4} on day 3{i} from the depot\n{passage}") for i in range(5)]
    rows += [(10, "Order was late again and nobody knew why it was"), (11, rows[0][1]), (12, None), (13, ""), (14, "short line\nshort line")]
    rows += [(20 + k, "An exact copy of a whole document with its own line") for k in range(4)]
    got = {r.doc_id: r for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in (0, 1, 2, 3, 4, 11):
        assert got[i].dropped == "1,2" and got[i].n_lines == 3 and got[i].text == own[i % 11]
    for i in (10, 13, 14, 20, 21, 22, 23):
        assert got[i].n_dropped == 0
    assert got[12].text is None and got[12].n_lines == 0 and got[20].text == rows[-1][1]
    assert line_dedup.drop_lines(docs).count() == docs.count() and line_dedup.drop_lines(no_docs).collect() == []


def test_line_dedup_drops_short_lines_on_more_evidence(spark):
    rows = [(i, f"Own text {chr(97 + i) * 5} of this one page\nAll rights reserved.\nOK\nPage 1{i} of 90" + "\nSee also" * (i < 5)) for i in range(6)]
    rows += [(10 + k, rows[5][1] + "\nSee also") for k in range(3)] + [(20, "OK then"), (21, " \n")]
    got = {r.doc_id: r for r in line_dedup.drop_lines(spark.createDataFrame(rows[:6] + rows[9:], "doc_id long, text string")).collect()}
    assert all(got[i].dropped == "1,2" for i in range(6)) and got[20].n_dropped == got[21].n_dropped == 0
    got = {r.doc_id: r for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].dropped == got[10].dropped == "1,2,4" and got[5].dropped == "1,2"


# ---------------------------------------------------------------- license scans
def brute_scan(text):
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    w = tokens(text)
    places = sorted((k, label) for label, p in license_scan.PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split())
    met, base = brute_met(text), {x for _, x in places}
    best = 1.0 if places else max(met.values(), default=0.0)
    return (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)),
            ",".join(sorted(base | set(met))), best)


def test_license_scan(spark, docs, no_docs):
    rng = np.random.default_rng(5)
    texts = ["GNU general public\nlicense", "cc by cc by", "smith license", "MIT-License!", "licensed under the apache"]
    for _, _, t in license_scan.TEMPLATES:
        w = t.split()
        texts += [t, t.upper(), " ".join(x for x in w if rng.uniform() < 0.9), " ".join(w[:-max(1, len(w) // 5)]), "before " + t + " after and more", t.replace(" ", "\n")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in license_scan.scan(df).collect())
    assert got == Counter((i, *(round(x, 9) if isinstance(x, float) else x for x in brute_scan(t))) for i, t in rows_of(df))
    assert license_scan.scan(no_docs).collect() == []


def brute_met(text, threshold=license_scan.THRESHOLD):
    """Labels of the templates that a line or a window of words meets, whatever the key words, with the largest containment."""
    tokens = lambda t: license_scan.plain(t).split()
    w, met = tokens(text), {}
    for label, _, t in license_scan.TEMPLATES:
        words, width = set(tokens(t)), -(-len(tokens(t)) * 5 // 4)
        assert threshold == 0.8
        for part in [tokens(x) for x in text.split("\n")] + [w[k:k + width] for k in range(max(1, len(w) - width + 1))]:
            c = len(words & set(part)) / len(words)
            if c >= threshold - 1e-12:
                met[label] = max(met.get(label, 0), c)
    return met


def test_license_scan_finds_wrapped_notices(spark):
    rng, texts = np.random.default_rng(6), ["fee for this", "the mit " * 50]
    for _, _, t in license_scan.TEMPLATES:
        w = t.split()
        for share in (1.0, 0.9, 0.8):
            picked = [x for x in w if rng.uniform() < share]
            texts.append("Some words before\n * " + "".join(x + (" " if rng.uniform() < 0.7 else "\n * ") for x in picked) + "and after")
        texts.append("the of and this to\n\n".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.scan(df).collect():
        met, base = brute_met(texts[r.doc_id]), set(filter(None, r.base_labels.split(",")))
        assert r.labels == ",".join(sorted(base | set(met))) and r.score == pytest.approx(1.0 if base else max(met.values(), default=0.0))
    near = [(1, "This is free software released into the public domain"), (2, "Licensed under the License, Version 2.0")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(near, "doc_id long, text string")).collect()}
    assert [(got[i].labels, got[i].keyed_labels, got[i].blocks[0].keyed) for i in (1, 2)] == [("unlicense", "", False), ("apache-2.0", "", False)]
    assert got[1].score == pytest.approx(9 / 11) and got[2].score == 7 / 8
    notice = license_scan.TEMPLATES[3][2].replace(", ", ",\n")
    r, = license_scan.scan(spark.createDataFrame([(1, "x\n" + notice)], "doc_id long, text string")).collect()
    assert r.labels == "mit" and r.score == 1.0 and [(b.line, b.last_line, b.label) for b in r.blocks] == [(1, 1 + notice.count("\n"), "mit")]
