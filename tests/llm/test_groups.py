import collections
import datetime as dt
import random

from scriptorium.llm import near_duplicates, shared_spans, survivor

LOC = "loc_id bigint, work_id bigint, tok_offset bigint, ref string, leaf int, text string, loaded_at timestamp, source string"
T = [dt.datetime(2024, 1, d) for d in range(1, 20)]


WORKS = "id bigint, key string, source string, author string, title string, unit string"
EDITIONS = [
    (1, "vates.armacano", "main", None, "Arma Cano", "line"), (2, "fp/vates/arma-cano.txt", "poor", "Vates", "ARMA", None), (3, "Vates.ArmaCano ", None, "V.", None, ""), (4, "vates.alia", "main", None, None, None),
    (5, "fp.vates:arma cano", "poor", None, None, None), (6, "vates_arma_cano", "main", " ", "x", None), (7, "fp.uates.armacano", "poor", None, None, None), (8, "fp.vates.armacano", "main", None, None, None), (9, None, "main", "a", "b", "c"),
]


def tables(spark):
    return spark.createDataFrame(EDITIONS, WORKS), spark.createDataFrame([("main", "mn", 90), ("poor", "fp", 20)], "source string, code string, trust int")


def survive(spark, rows):
    df = spark.createDataFrame([(i, w, 0, ref, leaf, text, at, "clash") for i, w, ref, leaf, text, at in rows], LOC)
    return sorted((r.loc_id, r.copies) for r in survivor.survivors(df, *tables(spark)).collect())


def test_work_identity(spark):
    got = {r.work_id: r.identity for r in survivor.editions(*tables(spark)).collect()}
    assert {got[k] for k in (1, 2, 3, 5, 6, 7)} == {"uatesarmacano"}
    # a code in front counts only if it is that of the edition's own source
    assert got[4] == "uatesalia" and got[8] == "fpuatesarmacano" and got[9] is None


def test_work_records_take_each_field_where_it_is_best(spark):
    got = {r.identity: tuple(r)[1:] for r in survivor.work_records(*tables(spark)).collect()}
    assert got == {"uatesarmacano": ("Vates", "Arma Cano", "line"), "uatesalia": (None, None, None), "fpuatesarmacano": (None, None, None)}


def test_all_forms_of_a_key_are_one_place(spark):
    rows = [(k, k, "1", 1, "some text", T[1]) for k in (1, 2, 3, 5, 7)] + [(6, 6, "I", 1, "some text", T[2]), (8, 8, "1", 1, "some text", T[9]), (9, 9, "1", 1, "some text", T[9])]
    assert survive(spark, rows) == [(6, 6)]


def test_survivor_rules(spark):
    rows = [
        (1, 1, "1", 1, "short", T[9]), (2, 2, "I.", 1, "short but long enough here", T[5]), (3, 2, "001", 1, "short but long enough there", T[4]),  # length, then time
        (4, 1, "1", 2, "abcdefgh  ", T[1]), (5, 2, "1.2", None, "abcdefghij", T[9]), (6, 3, "1", 2, "abcdefghij", T[9]),  # 8 of 10 stays: trust wins
        (7, 1, "2", 1, "alone", T[1]),
        (8, 4, "1", 1, None, T[1]), (9, 4, "1", 1, "", T[2]), (10, 4, "1", 1, "  ", T[1]),  # all empty: the latest
        (11, 1, None, 1, "x", T[1]), (12, 1, None, 1, "x", T[1]), (13, 99, "1", 1, "x", T[1]), (14, 1, "", 1, "x", T[1]),
    ]
    assert survive(spark, rows) == [(2, 3), (4, 3), (9, 3)]


def test_survivor_ties_and_empty(spark):
    assert survive(spark, [(5, 1, "1", 1, "x", T[1]), (4, 1, "1", 1, "x", T[1])]) == [(4, 2)]
    assert survive(spark, []) == []


def test_missing_times_follow_learned_order(spark):
    # in three places the padded spelling came after the plain one; in the fourth its time is missing
    rows = [(10 * k + j, 1, ref, k, "text", T[j]) for k in (1, 2, 3) for j, ref in ((1, "1"), (2, "01"))]
    assert (91, 2) in survive(spark, [*rows, (90, 1, "1", 9, "text", T[5]), (91, 1, "01", 9, "text", None)])
    assert (91, 2) in survive(spark, [*rows, (90, 1, "1", 9, "text", None), (91, 1, "01", 9, "text", None)])
    assert (90, 2) in survive(spark, [*rows, (90, 1, "01", 9, "text", T[5]), (91, 1, "1", 9, "text", None)])


def test_chains_of_missing_times(spark):
    # plain before padded, and padded before Roman, are seen; the three together never
    rows = [(10 * k + j, 1, ref, k, "text", T[j]) for k in (1, 2) for j, ref in ((1, "1"), (2, "01"))]
    rows += [(10 * k + j, 1, ref, k, "text", T[j]) for k in (3, 4) for j, ref in ((1, "01"), (2, "I"))]
    untimed = lambda *refs: [(90 + k, 1, ref, 9, "text", None) for k, ref in enumerate(refs)]
    assert (92, 3) in survive(spark, rows + untimed("1", "01", "I"))
    assert (90, 3) in survive(spark, rows + untimed("I", "1", "01"))
    assert (91, 2) in survive(spark, rows + untimed("1", "I"))  # never seen next to each other
    # one move from Roman to plain closes a circle: the rarest move of it does not count
    rows += [(51, 1, "I", 5, "text", T[1]), (52, 1, "1", 5, "text", T[2])]
    assert (92, 3) in survive(spark, rows + untimed("1", "01", "I"))


def brute_runs(streams):
    seen = collections.defaultdict(set)
    for w, s in streams.items():
        for i in range(len(s) - 11):
            seen[tuple(s[i : i + 12])].add(w)
    out = []
    for w, s in streams.items():
        cover = sorted({i + k for i in range(len(s) - 11) if len(seen[tuple(s[i : i + 12])]) > 1 for k in range(12)})
        cuts = [k for k in range(1, len(cover)) if cover[k] != cover[k - 1] + 1]
        out += [(w, cover[a], cover[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(cover)]) if b > a]
    return sorted(out)


def test_shared_runs(spark, monkeypatch):
    monkeypatch.setattr(shared_spans, "BLOCK_WORDS", 32)  # so that runs cross blocks
    r = random.Random(3)
    fresh = lambda n: [r.randrange(10**6) for _ in range(n)]
    common, edge, short = fresh(70), fresh(12), fresh(11)
    streams = {1: fresh(30) + common + fresh(20) + edge + fresh(5), 2: common[10:] + fresh(7) + edge, 3: edge + short + fresh(3), 4: fresh(9) + short + fresh(9), 5: fresh(3), 6: fresh(20) * 2, 7: common + common}
    rows = [(hash(tuple(s[i : i + 5])), w, i, "x") for w, s in streams.items() for i in range(len(s) - 4)]
    df = spark.createDataFrame(rows + rows[:40] + [(None, 1, 3, ""), (5, None, 3, ""), (5, 1, None, "")], "hash bigint, work_id bigint, tok_offset bigint, text string")
    assert sorted(map(tuple, shared_spans.shared_runs(df).collect())) == brute_runs(streams)
    shares = {x.work_id: x for x in shared_spans.shared_shares(df.where("work_id IS NOT NULL")).collect()}
    assert shares[6].n_shared == 0 and shares[7].share == 1.0 and shares[2].n_runs == 2
    assert shared_spans.shared_runs(df.limit(0)).count() == 0


def test_two_hashes_at_one_offset(spark):
    """An offset loaded with two hashes stands for both; no run through either is lost."""
    words = lambda w, n, start=0: [(1000 * w + k, k) for k in range(start, start + n)]
    common = [(7 * k + 1, k) for k in range(30)]
    rows = [(h, 1, k) for h, k in common] + [(-5 - k, 1, k) for k in (4, 9, 11, 12)] + [(h, 2, k + 50) for h, k in common] + [(99, 2, 54)] + [(h, 3, k) for h, k in words(3, 20)]
    df = spark.createDataFrame(rows, "hash bigint, work_id bigint, tok_offset bigint")
    assert sorted(map(tuple, shared_spans.shared_runs(df).collect())) == [(1, 0, 33), (2, 50, 83)]


def brute_pairs(texts):
    bags = {k: collections.Counter(t.lower().split()) for k, t in texts.items() if t and len(t.split()) >= 5}
    size = {k: sum(b.values()) for k, b in bags.items()}
    return sorted((a, b) for a in bags for b in bags if a < b and sum((bags[a] & bags[b]).values()) * 4 >= 3 * max(size[a], size[b]))


def random_texts(seed, n, lengths):
    r = random.Random(seed)
    letters = "abcdefghiklmnopqrst"
    vocab = ["".join(r.choice(letters) for _ in range(r.randrange(1, 4))) for _ in range(60)]
    out = {}
    for k in range(n):
        if k > 3 and r.random() < 0.6 and out[k - 1]:
            w = out[r.randrange(k)].split() or ["a"]
            for _ in range(r.randrange(0, 1 + len(w) // 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.4:
                r.shuffle(w)
            out[k] = " ".join(w[: len(w) - r.randrange(0, 3)] if r.random() < 0.5 else w + [r.choice(vocab)])
        else:
            out[k] = " ".join(r.choice(vocab) for _ in range(r.choice(lengths)))
    return out


def near(spark, texts):
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "id bigint, t string, text string")
    return sorted(map(tuple, near_duplicates.near_duplicate_pairs(df, "id", "t").collect()))


def test_pairs_by_brute_force(spark):
    for seed, lengths in ((1, [5, 6, 7, 8, 9, 12]), (2, [20, 24, 27, 28, 29, 30, 36, 40])):  # the second crosses the border of the tiles
        texts = random_texts(seed, 160, lengths)
        got = near(spark, texts)
        assert got == brute_pairs(texts) and len(got) > 20


def test_pairs_edges(spark):
    texts = {1: "a a a a b", 2: "a a b b b", 3: "a b a a a", 4: None, 5: "", 6: "a b c d", 7: "A, Ā; a a b!", 8: "b a a a a"}
    assert near(spark, texts) == brute_pairs({1: "a a a a b", 2: "a a b b b", 3: "a b a a a", 7: "a a a a b", 8: "b a a a a"})
    assert near(spark, {}) == []


def test_groups(spark):
    texts = {1: "a b c d e f g h", 2: "h g f e d c b a", 3: "a b c d e f g x", 4: "q r s t u v", 5: "a b"}
    df = spark.createDataFrame(list(texts.items()), "id bigint, t string")
    got = {r.record: (r["class"], r.class_size, r.links) for r in near_duplicates.near_duplicate_groups(df, "id", "t").collect()}
    assert got == {1: (1, 2, 1), 2: (1, 2, 1), 3: (3, 1, 2), 4: (4, 1, 0)}


def test_many_copies_do_not_multiply_inside(spark):
    df = spark.range(3000).selectExpr("id", "'a b c d e f g' AS t")
    got = near_duplicates.near_duplicate_groups(df, "id", "t").groupBy("class", "class_size", "links").count().collect()
    assert [tuple(r) for r in got] == [(0, 3000, 0, 3000)]
