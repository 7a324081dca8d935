"""The operators on groups of rows, against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from texts import awkward, frame, words_of

from tributary.llm import chat, common, jaccard_join, repeats, top_k
from tributary.llm.components import components

# --- repeated byte strings --------------------------------------------------------------------------------------------


def brute_repeats(rows, keep_first, size=200):
    seen, count = {}, collections.Counter()
    texts = sorted((i, (t or "").encode()) for i, t in rows)
    for i, b in texts:
        for k in range(len(b) - size + 1):
            count[b[k : k + size]] += 1
            seen.setdefault(b[k : k + size], (i, k))
    out = {}
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            w = b[k : k + size]
            if count[w] > 1 and (not keep_first or seen[w] != (i, k)):
                gone[k : k + size] = True
        edges = np.diff(np.concatenate([[0], gone.view(np.int8)]))
        out[i] = (len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def repeat_rows():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop qé") for _ in range(n))
    line, near = text(260), text(900)
    hot = [(1000 + k, line + text(rng.randint(0, 400))) for k in range(30)]
    copies = [(2000 + k, near[: (p := rng.randint(0, 880))] + text(12) + near[p + 12 :]) for k in range(20)]
    small = [(i, t) for i, t in awkward() if i not in (9, 10, 11)]
    return small + hot + copies + [(9, "z" * 3000), (10, "ab " * 900), (3000, "x" * 199), (3001, line + text(300) + line)]


def periodic_rows():
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop qé") for _ in range(n))
    period = "".join(rng.choice("ab") for _ in range(7))
    mixed = [(k, text(rng.randint(0, 120)) + (period * 60)[rng.randint(0, 6) : rng.randint(240, 420)] + text(rng.randint(0, 120))) for k in range(30)]
    return mixed + [(100 + k, "y" * rng.randint(150, 700) + text(50)) for k in range(10)]


@pytest.mark.parametrize("make", [repeat_rows, periodic_rows])
@pytest.mark.parametrize(("keep", "group"), [("none", 512), ("none", 4), ("first", 4)])
def test_repeats(spark, monkeypatch, make, keep, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = make()
    got = {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(frame(spark, rows), keep=keep).collect()}
    assert got == brute_repeats(rows, keep == "first")


def test_repeats_edges(spark):
    twice = [(1, "q" * 150 + "r" * 150), (1, "q" * 150 + "r" * 150), (None, "unique " * 3)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(frame(spark, twice)).collect())
    assert got == [(0, 21, 0), (1, 300, 300), (1, 300, 300)]
    assert repeats.remove_repeats(frame(spark, [])).count() == 0
    left = repeats.remove_repeats(frame(spark, [(1, "short")]), texts=True).collect()
    assert left[0].kept == b"short"


def test_rows_that_share_an_id_keep_their_own_spans(spark):
    text = "".join(random.Random(k).choice("abcdefgh ") for k in range(260))
    for ids, schema in (((1, 2), "doc_id bigint, text string"), (("a", "b"), "doc_id string, text string")):
        rows = [(ids[0], "other"), (ids[0], text), (ids[1], text + "!"), (None, "x")]
        got = sorted((r.doc_id or "", r.n_bytes, r.n_removed) for r in repeats.remove_repeats(frame(spark, rows, schema)).collect() if r.doc_id)
        assert got == [(ids[0], 5, 0), (ids[0], 260, 260), (ids[1], 261, 260)]
        first = sorted((r.doc_id or "", r.n_bytes, r.n_removed) for r in repeats.remove_repeats(frame(spark, rows, schema), keep="first").collect() if r.doc_id)
        assert first == [(ids[0], 5, 0), (ids[0], 260, 0), (ids[1], 261, 260)]


def test_structured_texts_do_not_collide():
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((one + " " + other).encode(), np.uint8)
    hashes, _, _, per = common.word_hashes(data, np.array([0, len(data)]))
    assert len(hashes) == 2 and hashes[0] != hashes[1]


def test_smaller_neighbours():
    rng = np.random.default_rng(1)
    for _ in range(100):
        x = rng.permutation(int(rng.integers(1, 60)))
        want = [next((j for j in range(i - 1, -1, -1) if x[j] < x[i]), -1) for i in range(len(x))]
        assert repeats.previous_smaller(x).tolist() == want


# --- chat formatting --------------------------------------------------------------------------------------------------


def test_chat_round_trip():
    rng = random.Random(3)
    bits = ["<|im_end|>", "<|im_start|>", "\n", "\\", "<", "|", ">", "a", "n", "", "assistant", "é"]
    some = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
    for _ in range(1500):
        turns = [(rng.choice(["user", "assistant", some()]), some()) for _ in range(rng.randint(0, 5))]
        r = chat.Rendered(turns)
        assert chat.read_back(r.text) == turns and r.rewrites == 0
        assert [chat.unescape(r.text[a:b]) for a, b in r.loss] == [t for role, t in turns if role == "assistant"]
        assert "".join(r.text[a:b] for a, b in r.spans) == r.text


def test_history_rewrites_are_seen():
    numbered = lambda turns: f"{len(turns)}:" + "".join(t for _, t in turns)
    assert chat.Rendered([("user", "x"), ("assistant", "y")], numbered).rewrites == 1


TEMPLATES = {
    "default": chat.template,
    "first turn differs": lambda turns: "".join(("<s>" if k == 0 else "") + f"[{r}]{t}[/]" for k, (r, t) in enumerate(turns)),
    "merged roles": lambda turns: "".join(("" if k and turns[k - 1][0] == r else f"<{r}>") + t + "." for k, (r, t) in enumerate(turns)),
    "numbered turns": lambda turns: "".join(f"{k}.{r}: {t}\n" for k, (r, t) in enumerate(turns)),
    "last answer only": lambda turns: "".join(t if r != "assistant" or k == len(turns) - 1 else "(cut)" for k, (r, t) in enumerate(turns)),
    "ending": lambda turns: "".join(r + t for r, t in turns) + "END",
}


@pytest.mark.parametrize("name", TEMPLATES)
def test_windows_give_what_every_prefix_gives(name):
    rng = random.Random(7)
    for _ in range(150):
        turns = [(rng.choice(["user", "assistant", "system"]), "".join(rng.choice("ab<|.\\") for _ in range(rng.randint(0, 5)))) for _ in range(rng.randint(0, 12))]
        got, want = chat.Rendered(turns, TEMPLATES[name]), chat.Rendered([], TEMPLATES[name])
        want.every_prefix(turns, TEMPLATES[name], ("assistant",))
        assert (got.text, got.spans, got.rewrites) == (want.text, want.spans, want.rewrites), turns
        assert [got.text[a:b] for a, b in got.loss] == [want.text[a:b] for a, b in want.loss] and got.loss == want.loss, turns


def test_long_conversations_take_linear_time(monkeypatch):
    calls = [0]

    def counted(turns):
        calls[0] += sum(len(t) for _, t in turns)
        return chat.template(turns)

    turns = [("user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(20_000)]
    r = chat.Rendered(turns, counted)
    assert calls[0] < 12 * sum(len(t) for _, t in turns) and chat.read_back(r.text) == turns
    monkeypatch.setattr(chat, "HELD", 100)
    assert chat.digest_row(iter(turns))[0] == 20_000


def test_the_query_has_its_conversation(spark, tmp_path):
    rows = [(5, 1, "assistant", "b <|im_end|>"), (5, 0, "user", "a"), (6, 0, "user", None)]
    frame(spark, rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op4_chat_format(spark, str(tmp_path)).collect()}
    says = "<|im_end|><|im_start|>assistant ok"
    assert sorted(got) == [-1, 5, 6] and (got[-1].n_turns, got[-1].loss_chars) == (2, len(says))
    assert got[-1].loss_sha256 == hashlib.sha256(says.encode()).hexdigest()
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{says}\nassistant\n{says}\n".encode()).hexdigest()
    assert got[5].loss_sha256 == hashlib.sha256(b"b <|im_end|>").hexdigest() and got[6].loss_chars == 0


def test_chat_digests(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "hi <|im_end|>", "x" * 3000])) for c in (1, 2, None, 3) for t in range(c or 5)] + [(7, None, "assistant", "first"), (7, 0, "user", "b"), (7, 0, "user", "a")]
    df = frame(spark, rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.format_digests(df).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, r or "", r is not None, x or "", x is not None) for c, t, r, x in rows if c == conv))
        trained = "".join(x for _, _, role, _, x, _ in mine if role == "assistant")
        g = got[conv]
        assert g.n_turns == len(mine) and g.loss_chars == len(trained) and g.loss_sha256 == hashlib.sha256(trained.encode()).hexdigest()
        assert g.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, _, role, _, x, _ in mine).encode()).hexdigest()
    full = chat.format_conversations(df).collect()
    assert {r.conv_id: len(r.formatted) for r in full} == {c: g.formatted_chars for c, g in got.items()}
    assert chat.format_digests(df.where("false")).count() == 0


# --- exact search -----------------------------------------------------------------------------------------------------


def test_search_is_exact():
    rng = np.random.default_rng(1)
    for trial in range(80):
        d, n = int(rng.integers(1, 6)), int(rng.integers(2, 400))
        x = (rng.integers(-50, 50, (5, d))[rng.integers(0, 5, n)] + rng.integers(-3, 4, (n, d))).astype(float)
        ids = rng.permutation(n).astype(np.int64)
        q = ids % 7 == 0
        if not q.any():
            continue
        got = sorted(zip(*(c.tolist() for c in top_k.search(ids[q], x[q], ids, x, 4)), strict=True))
        want = [(int(i), c, s) for i, v in zip(ids[q], x[q], strict=True) for s, c in sorted(((int(v @ y), int(c)) for c, y in zip(ids, x, strict=True) if c != i), key=lambda t: (-t[0], t[1]))[:4]]
        assert got == sorted(want), trial


def grouped_vectors(n, dim, groups, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-20000, 20000, (groups, dim))
    return (centres[rng.integers(0, groups, n)] + rng.integers(-200, 200, (n, dim))).astype(float)


def test_node_pairs_are_pruned_on_grouped_vectors():
    x, ids = grouped_vectors(6000, 12, 40, 5), np.arange(6000)
    q, work = ids % 10 == 0, []
    got = top_k.search(ids[q], x[q], ids, x, 10, work=work)
    scores = x[q] @ x.T
    scores[np.arange(q.sum()), ids[q]] = -np.inf
    want = sorted((int(i), int(c), int(r[c])) for i, r in zip(ids[q], scores, strict=True) for c in np.lexsort((ids, -r))[:10])
    assert sorted(zip(*(g.tolist() for g in got), strict=True)) == want
    bounded, scored = work
    assert bounded + scored < 0.1 * q.sum() * len(x)
    # a floor at the k-th score prunes further and loses nothing
    more, floor = [], np.array([s for _, _, s in want], float).reshape(-1, 10).min(axis=1)
    again = top_k.search(ids[q], x[q], ids, x, 10, floor=floor, work=more)
    assert sorted(zip(*(g.tolist() for g in again), strict=True)) == want and sum(more) < sum(work)


@pytest.mark.parametrize("block", [8192, 100])
def test_blocks_keep_every_result(spark, monkeypatch, block):
    monkeypatch.setattr(top_k, "BLOCK", block)
    x = grouped_vectors(1500, 6, 12, 9) / 1024
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[4].tolist())], "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r) for r in top_k.top_k(df, df["vec_id"] % 100 == 0, 5).select("query_id", "rank", "vec_id", "score").collect())
    ids, v = np.array([*range(1500), 3]), np.floor(np.concatenate([x, x[4:5]]) * 1024)
    want = []
    for i in range(0, 1500, 100):
        s = v @ v[i]
        order = [c for c in np.lexsort((ids, -s)) if ids[c] != i][:5]
        want += [(i, k + 1, int(ids[c]), int(s[c])) for k, c in enumerate(order)]
    assert got == sorted(want)


def test_search_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (100, [0.25, -3.0]), (200, None), (300, [inf, 1.0]), (400, [nan, 1.0]), (500, [None, 1.0]), (600, []), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [7.0])]
    df = frame(spark, rows, "vec_id bigint, embedding array<float>")
    got = sorted(tuple(r) for r in top_k.top_k(df, df["vec_id"] % 100 == 0, 2).collect())
    up = 1024 * 1024
    # rows of the query's own id are no candidates; the vector of another length is not compared
    assert got == [(0, 1, 1, up), (0, 2, 2, up), (100, 1, 1, up // 4), (100, 2, 2, up // 4)]
    assert top_k.top_k(df.where("false"), df["vec_id"] % 100 == 0).count() == 0


def test_huge_components(spark):
    df = spark.createDataFrame([(0, [2e6, 1.0]), (1, [2e6, 2.0]), (2, [-2e6, 2.0])], "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in top_k.top_k(df, df["vec_id"] == 0).orderBy("rank").collect()]
    big = (2 * 10**6 * 1024) ** 2
    assert got == [(0, 1, 1, big + 2 * 1024**2), (0, 2, 2, 2 * 1024**2 - big)]


# --- near duplicates --------------------------------------------------------------------------------------------------


def brute_classes(rows, threshold=0.8):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    linked = [[j for j, t in enumerate(sets) if j != i and s and len(s & t) >= threshold * len(s | t) - 1e-9] for i, s in enumerate(sets)]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in linked[i])]) for i in range(len(rows))]
    return sorted((rows[i][0], rows[root[i]][0], len(linked[i])) for i in range(len(rows)))


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(3))
    passage = [word() for _ in range(30)]
    rows = awkward()
    for g in range(12):
        base = [word() for _ in range(rng.choice([3, 6, 60, 120]))] + passage * (g % 2)
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    got = sorted(tuple(r) for r in jaccard_join.near_duplicates(frame(spark, rows)).collect())
    assert got == brute_classes(rows)
    kept = jaccard_join.keep_first(frame(spark, rows), jaccard_join.near_duplicates(frame(spark, rows)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in got})


@pytest.mark.parametrize("block", [512, 7])
def test_classes_far_from_the_first_are_compared(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng, n = np.random.default_rng(3), jaccard_join.COORDINATES
    own = lambda: rng.integers(0, 256, n, dtype=np.uint8)
    changed = lambda base, k: np.where(np.isin(np.arange(n), rng.choice(n, k, replace=False)), own(), base).astype(np.uint8)
    rows, want = [(k, own()) for k in range(60)], {}
    for g in range(3):
        base = own()
        rows += [(100 * (g + 1) + k, changed(base, 12)) for k in range(g + 2)]
        want |= {100 * (g + 1) + k: 100 * (g + 1) for k in range(g + 2)}
    middle = changed(rows[0][1], 40)
    rows += [(500, middle), (501, changed(middle, 12))]
    df = spark.createDataFrame([(7, i, bytes(x)) for i, x in rows], "path bigint, rep bigint, sketch binary")
    near = jaccard_join.near_for(0.8)
    compared = jaccard_join.compared_with_first(df)
    edges = compared.where(compared["close"] >= near).select("a", compared["rep"].alias("b")).union(jaccard_join.rest_edges(compared, near))
    got = {r.id: r.root for r in components(edges).collect()}
    sketches = np.stack([x for _, x in rows])
    linked, root = jaccard_join.agreements(sketches) >= near * jaccard_join.COORDINATES, list(range(len(rows)))
    for _ in rows:
        root = [min(root[j] for j in np.flatnonzero(linked[i])) for i in range(len(rows))]
    every = {rows[i][0]: rows[root[i]][0] for i in range(len(rows)) if linked[i].sum() > 1}
    assert got == every and want.items() <= every.items() and 500 in every


def test_large_buckets_are_split_and_small_ones_are_not(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    rng, n = np.random.default_rng(6), jaccard_join.COORDINATES
    # forty that share sampled tokens but not their sketches, three alike, one alone, ten alike
    loose = [(i, [1] * 100 + rng.integers(2, 2**31, 28).tolist(), bytes(rng.integers(0, 256, n, dtype=np.uint8))) for i in range(40)]
    tight = bytes(rng.integers(0, 256, n, dtype=np.uint8))
    rows = loose + [(100 + i, [5] * n, bytes(n)) for i in range(3)] + [(200, [9] * n, bytes(n))] + [(300 + i, [7] * n, tight) for i in range(10)]
    classes = spark.createDataFrame(rows, "rep bigint, sampled array<int>, sketch binary")
    small, edges, lost = jaccard_join.split_runs(classes.select("rep", "sampled"), classes.select("rep", "sketch"), range(0, 3), jaccard_join.near_for(0.8), 0.8)
    assert sorted((r.rep, r["count"]) for r in small.where("rep between 100 and 199").groupBy("rep").count().collect()) == [(100, 3), (101, 3), (102, 3)]
    assert small.where("rep >= 200").count() == 0
    assert small.groupBy("path").count().agg({"count": "max"}).collect()[0][0] <= 4
    found = {(r.a, r.b) for e in edges for r in e.collect()}
    assert found == {(300, 300 + i) for i in range(1, 10)}  # they end at the bucket's first class
    assert {r.rep for r in lost.collect()} <= set(range(40)) and all(r.loss > 0 for r in lost.collect())


def test_what_is_near_to_a_class_that_ends_at_the_first_is_joined_to_it(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    rng, n, near = np.random.default_rng(4), jaccard_join.COORDINATES, jaccard_join.near_for(0.8)
    first = rng.integers(0, 256, n, dtype=np.uint8)
    ends, beside, other = first.copy(), first.copy(), first.copy()
    ends[:24] ^= 1
    beside[:70] ^= 1  # near to the one that ends, far from the first
    other[:] = ~first
    agree = lambda a, b: (a == b).mean()
    assert agree(ends, first) >= jaccard_join.same_for(near) and agree(beside, ends) >= near > agree(beside, first)
    rows = [(i, [7] * n, bytes(x)) for i, x in enumerate([first] * 5 + [ends, beside, other])]
    classes = spark.createDataFrame(rows, "rep bigint, sampled array<int>, sketch binary")
    _, edges, _ = jaccard_join.split_runs(classes.select("rep", "sampled"), classes.select("rep", "sketch"), range(0, 1), near, 0.8)
    found = {(r.a, r.b) for e in edges for r in e.collect()}
    assert {(0, 5), (0, 6)} <= found and all(7 not in e for e in found)
    for threshold in (0.2, 0.4, 0.6, 0.8, 0.95, 1.0):
        low = jaccard_join.near_for(threshold)
        assert jaccard_join.same_for(low) >= low >= jaccard_join.beside_for(low) >= low / 2 - 1e-9


def test_bucket_forest():
    rng, n = np.random.default_rng(5), jaccard_join.COORDINATES
    base = rng.integers(0, 256, (6, n), dtype=np.uint8)
    for sizes_of in ((3, 5, 2), (20, 1, 40), (16, 17, 2)):
        rows = np.concatenate([base[rng.integers(0, 6, m)] for m in sizes_of])
        edges, sizes = np.concatenate([[0], np.cumsum(sizes_of)]), rng.integers(90, 110, len(rows))
        root = jaccard_join.bucket_forest(sizes, rows, edges, 0.6, 0.8)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            for i in range(lo, hi):
                assert root[i] == min(j for j in range(lo, hi) if (rows[i] == rows[j]).all())


def test_pairs_amid_documents_that_share_their_passage(spark):
    rng = random.Random(12)
    rows, pairs = [], []
    for g in range(8):
        passage = [f"p{g}w{k}" for k in range(204)]
        for _ in range(500):
            rows.append((len(rows), " ".join([f"d{rng.randrange(10**9)}" for _ in range(130)] + passage + [f"d{rng.randrange(10**9)}" for _ in range(130)])))
        other = list(passage)
        for at in (20, 70, 120, 170):
            other[at] = "changed"
        pairs.append((10**6 + 2 * g, " ".join(passage)))
        pairs.append((10**6 + 2 * g + 1, " ".join(other)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows + pairs, "doc_id bigint, text string")).where("doc_id >= 1000000").collect()}
    assert got == {i: (i - i % 2, 1) for i, _ in pairs}


def test_near_duplicate_edges(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (6, None)]
    got = sorted(((r.doc_id or 0), r.class_id or 0, r.n_links) for r in jaccard_join.near_duplicates(frame(spark, rows)).collect())
    assert got == [(0, 0, 0), (5, 5, 1), (5, 5, 1), (6, 6, 0)]
    assert jaccard_join.near_duplicates(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    for n, m in ((30, 20), (60, 80), (1, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(100 + k, 101 + k) for k in range(15)]
        root = {x: x for e in edges if e[0] != e[1] for x in e}
        for _ in root:
            for a, b in edges:
                if a in root and b in root:
                    root[a] = root[b] = min(root[a], root[b])
        got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
        assert got == root


def test_runs_reach_the_recall():
    assert jaccard_join.runs_for(0.8, 0.99, 4) < jaccard_join.runs_for(0.8, 0.999999, 4)
    n = jaccard_join.runs_for(0.8, 0.999, 6)
    assert (1 - 0.8**6) ** n <= 0.001


@pytest.mark.parametrize("threshold", [0.4, 0.8, 1.0])
def test_other_thresholds(spark, threshold):
    rng = random.Random(21)
    rows = []
    for g in range(25):
        base = [f"w{g}x{k}" for k in range(40)]
        for _ in range(4):
            w = list(base)
            for at in rng.sample(range(40), rng.randint(0, 4)):
                w[at] = f"c{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    got = sorted(tuple(r) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), threshold=threshold).collect())
    assert got == brute_classes(rows, threshold)


def test_pairs_beside_a_bucket_of_over_two_thousand_near_copies_are_kept(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
        return words

    rows = [(i, edited(base, rng.randint(1, 4))) for i in range(jaccard_join.SMALL + 150)]
    for p in range(30):
        x = edited(base, 5)
        rows += [(10**6 + 2 * p, x), (10**6 + 2 * p + 1, edited(x, 6))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string").repartition(8)
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(df).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in rows}
    for i in [i for i in sets if i >= 10**6]:
        links = [k for k, s in sets.items() if k != i and len(s & sets[i]) >= 0.8 * len(s | sets[i])]
        assert got[i].n_links == len(links) and all(got[k].class_id == got[i].class_id for k in links)
