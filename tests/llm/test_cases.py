"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and each method's own claims."""

import io
import random

import numpy as np
import pytest

import brute
from marginalia.llm import chunks, decontaminate, license, pack, pii, quality, secrets, similar, simhash, tokens, warc
from marginalia.llm import queries as q
from marginalia.llm.common import new_path, ship

EXTRA = "spans string, findings string, n_words long, hit string, items string, fp long, digest string, id long, kept boolean"
LONG = "word " * 30_000 + "7" * 30_000 + " a@b.cc " + "x" * 20_000
ROWS = [
    (1, None), (2, ""), (3, " \n "), (4, LONG), (5, "tok token = 'abcdef12' AKIA" + "Z" * 20 + " mail me.x@y.org_z@q.de +1 (743) 555-3824"),
    (6, "all rights reserved cc-by CC BY general public License"), (6, "all rights reserved cc-by CC BY general public License"),
    (None, "null id text with enough words to be kept here today ok"), (7, "é" * 50 + " 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111"),
]


@pytest.fixture(scope="module")
def odd(spark):
    ship(spark)
    return spark.createDataFrame([(d, t, *[None] * 9) for d, t in ROWS], "doc_id long, text string, " + EXTRA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("doc_id = -1")


def by_id(rows, *cols):
    return sorted(((r["doc_id"], *[r[c] for c in cols]) for r in rows), key=repr)


def test_pii_cases(odd, none):
    got = pii.find_personal(odd).collect()
    show = lambda s: ",".join(f"{x.kind}:{x.start}:{x.end}" for x in s)
    assert sorted(((r.doc_id, show(r.base)) for r in got), key=repr) == sorted(((d, brute.personal(t)[1]) for d, t in ROWS), key=repr)
    assert pii.find_personal(none).count() == 0


def test_pii_adds_spans_the_model_accepts(spark):
    rows = [(i, f"x y. Please contact Dr. John Smith{i % 3 * 'a'} today, or call (743) 555-{1000 + i}. Thanks.") for i in range(40)]
    rows += [(100 + i, f"order # 743 555 {1000 + i} version") for i in range(5)]
    got = {r.doc_id: [(s.kind, s.start) for s in r.spans] for r in pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all({k for k, _ in got[i]} == {"name", "local_phone"} for i in range(40))


def test_the_fit_is_expectation_maximisation(spark):
    rng = random.Random(21)
    rows = {}
    for _ in range(40):
        key = (rng.randrange(3), tuple(rng.choice((-1, 0, 1)) for _ in range(4)), tuple(rng.randrange(2) for _ in range(3)))
        rows[key] = rng.randint(1, 500)
    df = spark.createDataFrame([(k, list(v), list(f), n) for (k, v, f), n in rows.items()], "kind int, votes array<int>, features array<int>, n long")
    got = pii.fit(df).first()
    patterns = [(p.kind, tuple(p.votes), p.n) for p in got.patterns]
    assert got.posterior == pytest.approx(brute.expectation_maximisation(patterns, len(pii.EXTRA)))
    assert any(got.accepted) and not all(got.accepted)


def test_numbers_that_fail_the_card_check_are_added(spark):
    rows = [(i, f"text pays by card {4000 + i} 1234 5678 901{i % 10} today") for i in range(60)] + [(100 + i, f"see invoice 97831614841{i:02d} there") for i in range(20)]
    got = {r.doc_id: [(s.kind, s.start) for s in r.spans] for r in pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(got[i]) == 1 and got[i][0][1] == 18 and got[i][0][0] in ("card", "number") for i in range(60))
    assert not any(k == "number" for i in range(20) for k, _ in got[100 + i])


def test_personal_spans_equal_a_plain_version(spark):
    rng = random.Random(41)
    parts = [
        "Dr. John Smith", "Mary Jones", "Mr Zed Quux", "Order #", "invoice 12345678901234", "call (743) 555-1234", "743-555-9999", "version 123-45-6789", "ssn: 123-45-6789", "000-12-3456",
        "IBAN DE89 3704 0044 0532 0130 00", "XX12 3456 7890 1234", "card 4111 1111 1111 1112", "4000 1234 5678 9010", "9807915762804490", "12 Main Street", "99 Elm Lane,", "a@b.com", "1.2.3.4",
        "+1 (743) 555-3824", "some words here.", "address", "page", "contact:", "\n", "regards,", "$",
    ]
    texts = {i: " ".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for i in range(300)}
    want = brute.personal_spans(texts)
    got = pii.find_personal(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: [(x.kind, x.start, x.end) for x in r.spans] for r in got} == want
    assert {k for v in want.values() for k, *_ in v} > set(pii.BASE_KINDS)


def test_all_secret_rules_equal_plain_searches(spark):
    import re

    rng = random.Random(42)
    word = lambda n: "".join(rng.choice("abcXYZ019") for _ in range(n))
    make = [
        lambda: f"eyJ{word(10)}.{word(12)}.{word(9)}", lambda: f"eyJ{word(3)}.x.y", lambda: f"ghp_{word(36)}", lambda: f"xghp_{word(36)}", lambda: f"gho_{word(20)}", lambda: f"xoxb-{word(14)}",
        lambda: "xoxz-1", lambda: f"https://{word(4)}:{word(6)}@host/x", lambda: "ftp://user:@h", lambda: f"Secret = '{word(9)}'", lambda: "token: abc", lambda: f"AKIA{'Q' * rng.randint(10, 30)}",
        lambda: "0123456789abcdef" * 2, lambda: "plain", lambda: "://", lambda: "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", lambda: "é\n",
    ]
    texts = {i: rng.choice((" ", "", "/", "\n")).join(rng.choice(make)() for _ in range(rng.randint(1, 12))) for i in range(400)}
    want = {}
    for d, t in texts.items():
        rows = []
        for order, r in enumerate(secrets.RULES):
            for m in re.finditer(r.pattern.replace(r"\z", r"\Z"), t, re.A):
                if r.name != "assign" or len(re.sub("^" + secrets._ASSIGN, "", m[0])) >= 6:
                    rows.append((m.start(), order, m.end(), r.name))
        want[d] = [(k, a, b) for a, _, b, k in sorted(rows)]
    got = secrets.find_secrets(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: [(f.kind, f.start, f.end) for f in r.findings] for r in got} == want
    assert {k for v in want.values() for k, *_ in v} == {r.name for r in secrets.RULES}


def test_secret_cases(odd, none):
    got = secrets.find_secrets(odd).collect()
    assert sorted(((r.doc_id, sum(f.kind == "assign" for f in r.findings), sum(f.kind == "access" for f in r.findings), sum(f.kind == "hex" for f in r.findings)) for r in got), key=repr) == sorted(((d, *brute.secret(t)[:3]) for d, t in ROWS), key=repr)
    assert secrets.find_secrets(none).count() == 0


def test_private_keys_go_whole(spark):
    rng = random.Random(9)
    line = lambda n: "".join(rng.choice("ABCXYZabcxyz0189+/") for _ in range(n))
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    body = [line(64) for _ in range(20)] + [line(22) + "=="]
    head = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-256-CBC,0011AABB", ""]
    short = [*body[:-1], line(23)]
    keys = [
        "\n".join([begin, *body, end]), "\r\n".join([begin, *head, *body, end]), "\\n".join([begin, *body, end]), " ".join([begin, *body, end]),
        "\n".join([begin, *body]), "\n".join([begin, *head, *short]), begin, "\n".join([begin, line(64) * 20_000, end]),
    ]
    rows = [(i, f"keep this\n{k}\nand this here") for i, k in enumerate(keys)]
    rows.append((len(rows), f"a {keys[4]}\nb {keys[0]} c"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.find_secrets(docs, carry=("doc_id", "text"))
    got = {r.doc_id: r.clean for r in found.select("doc_id", secrets.redact(found.text, found.findings).alias("clean")).collect()}
    assert got == {i: "keep this\n[SECRET]\nand this here" for i in range(len(keys))} | {len(keys): "a [SECRET]\nb [SECRET] c"}


def test_ledger_drops_findings_of_old_versions(spark):
    path = new_path(spark, "test-ledger")
    docs = spark.createDataFrame([(1, "-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----")], "doc_id long, text string")
    header = secrets.Rule("pem", 1, r"-----BEGIN PRIVATE KEY-----")
    old = tuple(header if r.name == "pem" else r for r in secrets.RULES)
    assert [f.end for f in secrets.find_secrets(docs, path, old).first().findings] == [27]
    assert [(f.kind, f.start, f.end) for f in secrets.find_secrets(docs, path).first().findings] == [("pem", 0, 57)]


def test_ledger_scans_only_what_is_new(spark):
    path = new_path(spark, "test-ledger")
    one = spark.createDataFrame([(1, "token=abcdefgh"), (2, "clean")], "doc_id long, text string")
    two = spark.createDataFrame([(3, "token=abcdefgh"), (4, "AKIA" + "Q" * 20)], "doc_id long, text string")
    first = tuple(r for r in secrets.RULES if r.name != "access")
    secrets.find_secrets(one, path, first).count()
    assert spark.read.parquet(path).count() == 2
    got = {r.doc_id: [f.kind for f in r.findings] for r in secrets.find_secrets(one.union(two), path, secrets.RULES).collect()}
    assert got == {1: ["assign"], 2: [], 3: ["assign"], 4: ["access"]}
    later = [r.rules for r in spark.read.parquet(path).collect()]
    assert sorted(map(len, later)) == [1, 1, 7, 7, 8]


def test_redact(spark):
    df = spark.createDataFrame([(1, "é token=abcdefgh end"), (2, "token=" + "a1" * 15), (3, "none")], "doc_id long, text string")
    led = secrets.find_secrets(df, carry=("doc_id", "text")).withColumn("out", secrets.redact(__import__("pyspark").sql.functions.col("text"), __import__("pyspark").sql.functions.col("findings")))
    assert {r.doc_id: r.out for r in led.collect()} == {1: "é [SECRET] end", 2: "[SECRET]", 3: "none"}


def test_redaction_with_and_without_a_ledger(spark, odd, none):
    wide = odd.withColumns({"n_chars": odd.n_words, "__done": odd.spans})
    here = secrets.redact_texts(wide, length_col="n_chars")
    there = secrets.redact_texts(wide, new_path(spark, "test-ledger"), length_col="n_chars")
    assert here.columns == there.columns == wide.columns
    rows = lambda df: sorted(((r.doc_id, r.text, r.n_chars) for r in df.collect()), key=repr)
    assert rows(here) == rows(there) and len(rows(here)) == len(ROWS)
    assert {(r.doc_id, r.text, r.n_chars) for r in here.collect() if r.doc_id == 5} == {(5, "tok [SECRET]' [SECRET] mail me.x@y.org_z@q.de +1 (743) 555-3824", 63)}
    assert secrets.redact_texts(none).count() == 0


def test_decontaminate_cases(spark, odd, none):
    items = [(1, "one two three"), (2, " ".join(f"w{i}" for i in range(30))), (3, None), (4, "..."), (2, "extra item same id word list here now and then some")]
    docs = [(1, "x one, TWO three y"), (2, "a " + " ".join(f"w{i}" for i in range(5, 18)) + " b"), (3, " ".join(f"w{i}" for i in range(9))), (4, None)]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = {k: v[:3] for k, v in brute.contamination(docs, [(i, t) for i, t in items]).items()}
    for size, most in ((1 << 27, 4), (1, 1 << 60), (1, 0)):  # one block, a block for every item, joins of rows
        got = {r.doc_id: (r.n_words, sum(x.e - x.s for x in r.hit), len(r["items"])) for r in decontaminate.find_hits(d, b, block_bytes=size, most_blocks=most).collect()}
        assert got == want
    assert decontaminate.find_hits(d, b.filter("item_id < 0")).filter("size(hit) > 0").count() == 0
    assert decontaminate.find_hits(none, b).count() == 0
    assert len(decontaminate.find_hits(odd, b, carry=tuple(odd.columns), prefix="__b_").columns) == len(odd.columns) + 3


def test_joined_fingerprints_find_what_the_index_finds(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda **o: sorted((r.doc_id, r.n_words, [(x.s, x.e) for x in r.hit], r["items"]) for r in decontaminate.find_hits(docs, bench, **o).collect())
    want = rows()
    assert any(r[2] for r in want) and rows(most_blocks=0) == want
    nameless = spark.createDataFrame([(None, docs.filter("length(text) > 500").first().text)], "item_id long, text string")
    got = {m: sorted((r.doc_id, len(r.hit), r["items"]) for r in decontaminate.find_hits(docs, nameless, most_blocks=m).collect()) for m in (4, 0)}
    assert got[4] == got[0] and any(n for _, n, _ in got[0]) and not any(i for _, _, i in got[0])


def test_winnowing_guarantee():
    rng = random.Random(1)
    words = [f"v{i}".encode() for i in range(6)]
    for _ in range(200):
        item = [rng.choice(words) for _ in range(40)]
        at = rng.randrange(30)
        doc = [rng.choice(words) for _ in range(20)] + item[at : at + 10] + [rng.choice(words) for _ in range(20)]
        ix = decontaminate.Index([(1, item)])
        got = ix.hits(np.array([ix.number.get(w, 0) for w in doc]))
        assert (20, 10) in {(s, n) for s, n, _ in got}


def test_pack_cases(spark, odd, none):
    assert pack.pack_documents(none, q.tokenizer_path()).count() == 0
    rows = pack.pack_documents(odd, q.tokenizer_path()).collect()
    assert sum(r.doc_id == 6 for r in rows) == 2 and [r.length for r in rows if r.doc_id == 1] == [1]


def test_pack_rounds_reach_the_bound(spark):
    sizes = np.random.default_rng(0).integers(1, 1024, 3000)
    rows = spark.createDataFrame([(int(i), 0, 0, int(s), int(i)) for i, s in enumerate(sizes)], pack.PIECE)
    one = pack.pack(rows, per_partition=10_000).select("sequence_id").distinct().count()
    many = pack.pack(rows, per_partition=300).select("sequence_id").distinct().count()
    bound = pack.lower_bound(sizes, 1024)
    assert bound <= one <= many <= 1.03 * one


def test_pack_keeps_large_and_null_ids(spark):
    big = 1 << 53
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (big + 1, "one two"), (big + 3, "three"), (None, None)], "doc_id long, text string").coalesce(1)
    got = pack.pack_documents(rows, q.tokenizer_path()).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted([None, None, None, big + 1, big + 3], key=repr)
    assert len({r.sequence_id for r in got}) == 1 and len({r.offset for r in got}) == 5


def test_pack_certificates(spark):
    sizes = np.random.default_rng(0).integers(1, 1024, 3000)
    rows = spark.createDataFrame([(int(i), 0, 0, int(s), int(i)) for i, s in enumerate(sizes)], pack.PIECE)
    packed, notes = pack.pack_certified(rows, per_partition=300)
    held = notes.collect()
    assert {r.round for r in held} >= {0, 1} and all(r.bound <= r.bins for r in held)
    assert sum(r.pieces for r in held if r.round == 0) == 3000 == packed.count()
    used = [{(r.sequence_id) for r in packed.collect()}]
    assert len(used[0]) <= sum(r.bins for r in held if r.round == 0)


def test_lower_bound_is_sound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        s = rng.integers(1, 101, rng.integers(1, 60))
        bins, left = pack.best_fit_decreasing(s, 100)
        assert pack.lower_bound(s, 100) <= len(left)
        assert all(s[bins == b].sum() + left[b] == 100 for b in range(len(left)))
    assert pack.lower_bound(np.array([60] * 7), 100) == 7


def test_anchor_covering_misses_no_pair():
    rng = random.Random(3)
    fps = []
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 5)):
            y ^= 1 << b
        fps.append((x, y))
    for x, y in fps:
        keys = [set(simhash.anchors(np.array([v], np.uint64))[1].tolist()) for v in (x, y)]
        assert keys[0] & keys[1]
        assert all(len(k) <= 32 for k in keys)


def test_simhash_cases(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ROWS) and simhash.near_duplicates(none).count() == 0
    assert {(r.doc_id, r.component) for r in got if r.doc_id in (1, 2, 3)} == {(1, 1), (2, 1), (3, 1)}
    assert all(r.fp == 0 for r in got if r.doc_id in (1, 2, 3))


def groups_of(df, **options):
    return {(r.doc_id, bytes(r.digest)): r.component for r in similar.similar_groups(df, **options).collect()}


def components_of(spark, rows, **options):
    got = similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    assert len(got) == len(rows)
    return {r.doc_id: r.component for r in got}


def test_similar_cases(spark, odd, none):
    got = similar.similar_groups(odd).collect()
    assert sum(r.n for r in got) == len(ROWS) and similar.similar_groups(none).count() == 0
    assert {(r.doc_id, r.component) for r in got if r.doc_id in (1, 2, 3)} == {(1, 1), (2, 1), (3, 1)}
    assert {r.component for r in got if r.doc_id is None} == {None}
    assert {(r.doc_id, r.n) for r in got if r.doc_id == 6} == {(6, 2)}


def test_drop_similar_loses_no_text(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a, 7), (2, a, 8), (2, b, 9), (3, c, 1), (3, d, 2), (None, a, 3), (None, a, 4), (3, d, 2), (3, d, 1), (None, b + " more", 5), (None, "alone " + d[::-1], 6)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, n long, __digest string, __mark string")
    got = similar.drop_similar(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.n) for r in got.collect()), key=repr) == sorted([(1, a, 7), (2, b, 9), (3, c, 1), (3, d, 1), (None, "alone " + d[::-1], 6)], key=repr)


def test_similar_finds_edited_copies(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for group in range(60):
        source = [rng.choice(vocabulary) for _ in range(200)]
        rows.append((len(rows), " ".join(source)))
        for copy in range(40 if group == 0 else 2):
            w = list(source)
            for at in rng.sample(range(200), 3 if copy % 2 else 12):
                w[at] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    want = brute.alike(rows)
    assert sum(want[d] != d for d in want) > 70
    for cell in (similar.CELL, 4):  # whole groups, and groups cut into many cells
        assert components_of(spark, rows, cell=cell) == want


def test_similar_finds_added_and_cut_text(spark):
    rng = random.Random(6)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for n, more in [(100, 24), (400, 98), (200, 40), (20, 4), (12, 1)] * 24:
        source = prose(n)
        rows += [(len(rows), " ".join(source)), (len(rows) + 1, " ".join(source + prose(more)))]
        source = prose(n + more)
        rows += [(len(rows), " ".join(source)), (len(rows) + 1, " ".join(source[:n]))]
    want = brute.alike(rows)
    assert sum(want[d] != d for d in want) > 150 and components_of(spark, rows) == want


def test_similar_links_chains_and_equal_word_sets(spark):
    rng = random.Random(8)
    # every text has the same words: nearest by words says nothing about the shingles
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(60):
        source = rng.sample(vocabulary, 300)
        copy = list(source)
        copy[100], copy[101] = copy[101], copy[100]
        rows += [(len(rows), " ".join(source)), (len(rows) + 1, " ".join(copy))]
    chain = [f"c{i}" for i in range(700)]
    first = len(rows)
    rows += [(first + i, " ".join(chain[10 * i : 10 * i + 200])) for i in range(50)]
    for cell in (similar.CELL, 8):
        assert components_of(spark, rows, cell=cell) == {d: first if d >= first else d - d % 2 for d, _ in rows}


def test_long_runs_of_an_anchor_link_as_short_ones(spark):
    rng = np.random.default_rng(4)
    # one family shares its lower half, so all its members meet at the same anchors
    high = rng.integers(0, 1 << 31, 3000, np.int64).astype(np.uint64)
    high[1500:] = high[:1500] ^ (np.uint64(1) << rng.integers(0, 31, 1500).astype(np.uint64))
    fps = (high << np.uint64(32)) | np.uint64(12345)
    distinct = spark.createDataFrame([(int(x),) for x in np.unique(fps).view(np.int64)], "fp long").repartition(3)

    def roots(longest):
        up = {}

        def find(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for r in simhash.link(distinct, longest=longest).collect():
            a, b = find(r.u), find(r.v)
            up[max(a, b)] = min(a, b)
        return {x: find(x) for x in list(up)}

    assert roots(1 << 40) == roots(200) and len(roots(200)) >= 3000 - 10


def test_components_of_a_long_chain(spark):
    from marginalia.llm.components import connected_components

    n = 300
    e = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1000, 999)], "u long, v long")
    for local in (500_000, 0):
        got = {r.node: r.root for r in connected_components(e, local=local).collect()}
        assert all(got[i] == 0 for i in range(n + 1)) and got[1000] == got[999] == 999
        assert connected_components(e.filter("u < 0"), local=local).count() == 0


def test_quality_cases(odd, none):
    got = quality.quality(odd).collect()
    assert len(got) == len(ROWS) and quality.quality(none).count() == 0
    assert all(not r.kept for r in got if r.doc_id in (1, 2, 3, 4))
    assert [r.kept for r in got if r.doc_id is None] == [True]


def test_quality_verdict_has_its_own_scale(spark):
    stutter = " ".join(f"w{i}" for i in range(12) for _ in range(4))
    passage = " ".join(f"p{i}" for i in range(60))
    twice = " ".join([passage, *(f"m{i}" for i in range(800)), passage])
    title = "to the reader now\n" + " ".join(f"t{i}" for i in range(9)) + "\nto the reader now"
    rows = [(1, stutter), (2, twice), (3, " ".join(f"n{i}" for i in range(500))), (4, title)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (False, False), 2: (False, False), 3: (False, True), 4: (False, True)}
    for _, t in rows:
        assert quality.measure(t.encode())[5:] == brute.repeats(t.split(), 3)


def test_prefix_lengths_agree():
    rng = np.random.default_rng(3)
    for n, k in ((2, 1), (50, 2), (300, 3), (300, 1), (500, 200)):
        x = rng.integers(0, k, n)
        for a, b in zip(quality.suffix_array(x), quality.suffix_array(x, most_kept=0)):
            assert a.tolist() == b.tolist()


def test_suffix_array():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 40):
        for k in (1, 2, 5):
            x = rng.integers(0, k, n)
            sa, lcp = quality.suffix_array(x)
            t = x.tolist()
            assert sa.tolist() == sorted(range(n), key=lambda i: t[i:])
            want = [next((m for m in range(n) if max(a, b) + m >= n or t[a + m] != t[b + m]), n) for a, b in zip(sa, sa[1:])]
            assert lcp.tolist() == want


def test_chunks_resist_shifts():
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(400)).encode()

    def cut(t):
        c = chunks.boundaries(np.frombuffer(t, np.uint8)).tolist()
        return {t[a:b] for a, b in zip(c, c[1:])}

    moved = text[:700] + b"INSERTED" + text[700:]
    assert len(cut(text) - cut(moved)) <= 4
    for t in (b"", b"a", b"a" * 5000, "é".encode() * 3000):
        c = chunks.boundaries(np.frombuffer(t, np.uint8))
        assert c[-1] == len(t) and (not t or (np.diff(c) <= 1026).all())
        [t[a:b].decode() for a, b in zip(c.tolist(), c.tolist()[1:])]


def test_shared_passages_are_found(spark, none):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for i in range(150):
        p = prose(52)
        rows += [(3 * i, prose(80) + " " + p + " " + prose(60)), (3 * i + 1, prose(50) + " " + p + " " + prose(90)), (3 * i + 2, prose(150))]
        want[3 * i] = want[3 * i + 1] = p
    found = chunks.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got, texts = {r.doc_id for r in found}, dict(rows)
    assert not {d for d in got if d % 3 == 2}
    assert len(got) >= 0.98 * 300
    # the spans reach the passages' real ends
    assert all(want[r.doc_id] in texts[r.doc_id][r.start : r.end] for r in found)
    assert chunks.repeated_passages(none).count() == 0


def test_passages_repeated_inside_a_document_are_found(spark):
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))
    p = prose(200)
    text = " ".join([prose(80), p, prose(60), p, prose(50)])
    rows = [(1, text), (1, text), (2, prose(300))]
    got = sorted(chunks.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.first_ids, r.is_first, r.again) for r in got] == [(1, [1], True, False), (1, [1], True, True)]
    assert text[got[0].start : got[0].end] == text[got[1].start : got[1].end] and got[1].n_bytes > 0.8 * len(p)


def test_texts_of_one_id_are_told_apart(spark):
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))
    p = prose(80)
    texts = [prose(60) + " " + p + " end", p + " " + prose(70)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, prose(200)), (None, p)]
    got = chunks.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in got] == [1, 1] and len({r.version for r in got}) == 2
    assert sorted(r.again for r in got) == [False, True]
    assert all(any(p in t[r.start : r.end] for t in texts) for r in got)


def test_token_cache(spark, odd, none):
    path = new_path(spark, "test-cache")
    a = tokens.count_tokens(odd, q.tokenizer_path(), path).collect()
    n = spark.read.parquet(path).count()
    b = tokens.count_tokens(odd, q.tokenizer_path(), path).collect()
    assert by_id(a, "n_tokens") == by_id(b, "n_tokens") and spark.read.parquet(path).count() == n == 7
    assert tokens.count_tokens(none, q.tokenizer_path()).count() == 0
    t = tokens.load(q.tokenizer_path())
    assert by_id(a, "n_tokens") == sorted(((d, len(t.encode(x or "", add_special_tokens=False))) for d, x in ROWS), key=repr)


def test_ids_equal_the_library():
    path = q.tokenizer_path()
    t, count, ids = tokens.load(path), tokens.counter(path), tokens.id_bytes(path)
    rng = random.Random(31)
    pieces = ["a", "The", "wörd", "é", "12", ".", "'s", "'ll", "<|endoftext|>", "<|end", "日本", "\u00a0", "\u3000", "\t", "\r", " ", " ", " ", "\n", "\n", "  ", "\n\n", "\x1c", "\u2028", "!", ",", "?!", ")", "\"", "²", "Ⅷ", "½."]
    for _ in range(20_000):
        x = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert ids(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), repr(x)
    for s in ("", " ", "  ", " a", "a ", "a  b", "a <|endoftext|> b", "<|endoftext|>x", "it's  we'll\n\n x\ty", "a\x1c b", "1 22 é è!? ...\n", "日本 語　x"):
        assert count(s) == len(t.encode(s, add_special_tokens=False)), repr(s)


def test_license_cases(odd, none):
    got = license.scan_licenses(odd).collect()
    assert len(got) == len(ROWS) and license.scan_licenses(none).count() == 0
    assert {(r.n_base, r.first_word, r.last_word, r.base_labels) for r in got if r.doc_id == 6} == {(4, 0, 7, "cc-by,gpl,reserved")}


def test_license_columns_equal_a_plain_version():
    rng, s = random.Random(13), license.Searcher(license.notices())
    words = "all rights reserved cc by general public license gnu lesser affero the of free software licensed under apache version 2 0".split()
    notes = list(license.NOTICES)
    for _ in range(60):
        parts = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            note = list(rng.choice(notes))
            for _ in range(rng.randint(0, 3)):
                note[rng.randrange(len(note))] = rng.choice("abcxyz")
            at = rng.randint(0, len(parts))
            parts[at:at] = "".join(note).split()
        text = " ".join(parts)
        got = s.scan(text.encode())
        assert got[:5] == brute.licenses(text)
        labels, score = brute.notices(text, s.wanted)
        base = set(got[4].split(",")) - {""}
        assert got[5] == ",".join(sorted(base | labels)) and got[6] == pytest.approx(1.0 if base else score), text


def test_license_scan_is_linear():
    import time

    s = license.Searcher(license.notices())
    text = (b"all rights reserved under cc by terms and all rights reservd " * 20_000)
    began = time.time()
    assert s.scan(text)[1] == 40_000 and time.time() - began < 20


def test_fuzzy_notices():
    s = license.Searcher(license.notices())
    for text, label in ((b"Permision is hereby granted, free of charge, to any persn obtaining a copy of this sofware", "mit"), (b"Licensed under the Apache Licence, Version 2.0", "apache-2.0"), (b"all rights reservd", "reserved")):
        assert label in s.scan(text)[5].split(",")
    assert s.scan(b"permission to speak freely in the hall is granted on request")[5] == ""


def test_warc_ranges_own_each_record_once():
    blob = b"".join(warc.encode_record(i, f"http://x/{i}\r\n", (b"<p>%d</p>" % i) * (i * 37 % 200), "00" * 20, 5, "response", None) for i in range(60))
    whole = list(warc.read_range(io.BytesIO(blob), len(blob), 0, len(blob)))
    assert len(whole) == 60
    for step in (50, 777, 5000):
        got = [x for s in range(0, len(blob), step) for x in warc.read_range(io.BytesIO(blob), len(blob), s, min(s + step, len(blob)))]
        assert got == whole


def test_warc_cases(spark):
    ship(spark)
    rows = [(1, "u", "aa"), (2, None, "aa"), (2, "u2", "aa"), (1, "u", "aa"), (3, "u", None), (4, "u", ""), (None, "n", "aa"), (5, "line\nbreak", "é")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(((r.id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(spark, pages).collect()), key=repr)
    want = [(1, "response", None, 2), (1, "revisit", 1, 2), (2, "revisit", 1, 2), (2, "revisit", 1, 2), (3, "response", None, 0), (4, "revisit", 3, 0), (5, "response", None, 2), (None, "revisit", 1, 2)]
    assert got == sorted(want, key=repr)
    back = warc.round_trip(spark, pages).collect()
    # every row has a record with its own URI and an id of its own
    assert sorted((r.uri or "" for r in back)) == sorted((u or "").replace("\n", "%0A") for _, u, _ in rows)
    assert len({r.record_id for r in back}) == len(rows)
    two = spark.createDataFrame([(None, "http://a", "z"), (None, "http://b", "z"), (7, "http://c", "p"), (7, "http://d", "q")], "page_id long, url string, html string")
    back = warc.round_trip(spark, two).collect()
    assert sorted((r.uri, r.record_type) for r in back) == [("http://a", "response"), ("http://b", "revisit"), ("http://c", "response"), ("http://d", "response")]
    assert len({r.record_id for r in back}) == 4
    assert warc.round_trip(spark, pages.filter("page_id = -1")).count() == 0
