"""n-gram Jaccard join, substring de-duplication and decontamination against brute force."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegrain.llm import common, decontaminate, ngram_join, substring_dedup

VOCABULARY = [f"w{i}" for i in range(400)]
CLASHING = ("token", "root", "node", "a", "b", "doc", "at", "c0", "_key", "_text", "key", "id", "end", "kept")


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
    return " ".join(w)


def table(spark, texts):
    """With clashing extra columns."""
    df = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")
    return df.select("doc_id", "text", *(F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING)))


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(texts):
    sets = {i: shingles(t) for i, t in texts if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(rng, families=12, size=9):
    out, i = [], 0
    for _ in range(families):
        base = sentence(rng, rng.choice([6, 40, 120]))
        for _ in range(size):
            out.append((i, edited(rng, base, rng.randrange(4))))
            i += 1
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("hot", [32, 1])
def test_components_are_those_of_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT_GROUPS", hot)
    rng = random.Random(hot)
    texts = [*near_copies(rng), (900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "One  TWO"), (905, "w1 " * 900_000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_documents(table(spark, texts)).collect()}
    assert got == brute(texts)


def test_a_chain_that_no_hub_joins(spark):
    """Each text resembles its neighbours only."""
    rng = random.Random(8)
    text = sentence(rng, 200).split()
    texts = []
    for i in range(12):
        texts.append((100 - i, " ".join(text)))
        text[i * 16 : i * 16 + 8] = sentence(rng, 8).split()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_documents(table(spark, texts)).collect()}
    assert got == brute(texts)


def test_empty_null_and_repeated_keys(spark):
    assert ngram_join.similar_documents(table(spark, [])).count() == 0
    text = sentence(random.Random(1), 30)
    got = ngram_join.similar_documents(table(spark, [(5, text), (5, text), (None, text), (7, text)])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (5, 5), (5, 5), (7, 5)]
    kept = ngram_join.keep_one(table(spark, [(5, text), (5, text), (7, text), (8, None), (9, "")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [5, 8, 9] and set(CLASHING) <= set(kept.columns)


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 101), (101, 102), (102, 103), (103, 104), (None, 3), (7, 7)]
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in root:
        for a, b in edges:
            if a is not None and a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {n: r for n, r in root.items() if n != r}


def test_one_of_similar_rows_stays(spark):
    """Different texts under one doc_id are judged apart; of rows that repeat both, one stays."""
    rng = random.Random(41)
    a, b = sentence(rng, 60), sentence(rng, 60)
    rows = [(1, a), (2, a), (2, b), (3, edited(rng, b, 1)), (4, b), (4, b), (5, ""), (5, ""), (None, a), (6, "x y"), (6, "x y")]
    got = sorted(((r["doc_id"], r["text"]) for r in ngram_join.keep_one(table(spark, rows)).collect()), key=str)
    of_a, of_b = [x for x in got if x[1] == a and x[0]], [x for x in got if x[1] in (b, rows[3][1])]
    assert len(of_a) == 1 and len(of_b) == 1 and (None, a) in got and got.count((5, "")) == 2 and got.count((6, "x y")) == 1 and len(got) == 6
    assert ngram_join.keep_one(table(spark, [])).count() == 0


# --- substring de-duplication ---------------------------------------------------------------------------


def passages(rng):
    shared = sentence(rng, 60)
    docs = [(i, sentence(rng, 80 + i) + "\n" + shared + "\n" + sentence(rng, 70)) for i in range(6)]
    docs += [(i, sentence(rng, 150)) for i in range(10, 16)]
    return shared, docs


def test_shared_passages_stay_in_one_document(spark):
    shared, docs = passages(random.Random(2))
    spans = substring_dedup.repeated_spans(table(spark, docs)).collect()
    assert {r["doc_id"] for r in spans} == {1, 2, 3, 4, 5} and all(r["kept_doc_ids"] == [0] and r["n_words"] == 60 for r in spans)
    out = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(table(spark, docs)).collect()}
    source = dict(docs)
    assert out[0] == source[0] and all(out[i] == source[i] for i in range(10, 16))
    for i in range(1, 6):
        assert out[i].split() == source[i].replace(shared, "").split()


def test_passages_of_just_over_fifty_words_go_whole(spark):
    """Passages between other words, their lines broken anyhow, some with a word changed inside."""
    rng = random.Random(31)
    docs, want = [], {}
    for k in range(60):
        own = sentence(rng, 51 + k % 9).split()
        for c in range(3):
            before, after, own_c = sentence(rng, rng.randrange(60)).split(), sentence(rng, rng.randrange(60)).split(), own.copy()
            if k % 4 == 3 and c == 2:
                own_c[27] = "changed"
            i = 3 * k + c
            docs.append((i, " ".join(before) + "\n" + rng.choice([" ", "\n"]).join(own_c) + " " + " ".join(after)))
            want[i] = (len(before), len(own_c), len(after), k % 4 == 3 and c == 2)
    out = {r["doc_id"]: r["text"] or "" for r in substring_dedup.remove_repeats(table(spark, docs)).collect()}
    whole = 0
    for i, (before, own, after, changed) in want.items():
        left = len(out.get(i, "").split())
        if i % 3 == 0:
            assert left == before + own + after
        else:
            whole += left == before + after
            assert changed or abs(left - before - after) <= 3  # words beside it are equal by chance
    assert whole >= 0.95 * 105


def test_short_repeats_stay(spark):
    rng = random.Random(32)
    line = sentence(rng, 14)
    docs = [(i, sentence(rng, 40) + "\n" + line + "\n" + sentence(rng, 40)) for i in range(30)]
    assert substring_dedup.repeated_spans(table(spark, docs)).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    rng = random.Random(33)
    shared, other = sentence(rng, 120), "é " + sentence(rng, 60)
    docs = [(1, shared), (2, shared), (2, other), (2, other), (3, shared), (None, shared)]
    out = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in substring_dedup.remove_repeats(table(spark, docs)).collect()))
    kept = [x for x in out if x[2] == shared and not x[0]]
    assert len(kept) == 1 and [x for x in out if x[2] == other] == [(False, 2, other)] * 2 and (True, 0, shared) in out and len(out) == 4
    spans = substring_dedup.repeated_spans(table(spark, docs)).collect()
    assert len(spans) == 2 and {r["doc_id"] for r in spans} | {x for r in spans for x in r["kept_doc_ids"]} == {1, 2, 3}


def test_recall_of_similar_paragraphs_against_all_pairs(spark):
    """Whole short documents of one paragraph or few, with near copies: the links against a comparison of all pairs."""
    rng = random.Random(34)
    texts = []
    for _ in range(40):
        base = sentence(rng, 90).split()
        for v in range(5):
            w = base.copy()
            for _ in range(v):
                w[rng.randrange(90)] = rng.choice(base)
            texts.append(" ".join(w))
    import pyarrow as pa

    from lodegrain.llm.kernels import Words, buffers

    raw, off = buffers(pa.array(texts))
    p = substring_dedup.Paragraphs(Words(raw, off))
    small = (p.words.hash >> np.uint64(32)).astype(np.uint32)
    cuts = np.append(p.start, len(small))
    sets = substring_dedup.shingle_sets(small, cuts)
    assert [len(s) for s in sets] and (np.diff(cuts) == p.stop - p.start).all()
    near = [(int(p.row[i]), int(p.row[j])) for i in range(len(sets)) for j in range(i) if p.row[i] != p.row[j] and sets[i] != sets[j] and substring_dedup.alike(sets[i], sets[j])]
    rows = table(spark, list(enumerate(texts))).selectExpr("doc_id as doc", "text")
    found = substring_dedup._candidates(rows, 6)
    members = found.where("band is not null").selectExpr("doc", "shiftleft(at, 32) | size as a", "shiftleft(band, 1) | cast(many as int) as b")
    links = substring_dedup._verified(substring_dedup._contents(substring_dedup._asked(rows, members, "t")), 8, 80).collect()
    got = {frozenset((r["a"]["doc"], r["b"]["doc"])) for r in links}
    assert len(near) > 20 and all(r["a"]["doc"] != r["b"]["doc"] for r in links)
    # links that only tie what is linked already are left out, so components are compared
    def parts(pairs):
        root = list(range(len(texts)))
        for _ in range(20):
            for a, b in map(tuple, pairs):
                root[a] = root[b] = min(root[a], root[b])
        return root

    same = {frozenset((int(p.row[i]), int(p.row[j]))) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] and p.row[i] != p.row[j]}
    want, have = parts({frozenset(x) for x in near} | same), parts(got | same)
    assert sum(a == b for a, b in zip(want, have, strict=True)) >= 0.95 * len(texts)


def test_contents_of_a_crowded_key_are_split_and_still_meet(spark, monkeypatch):
    rng = random.Random(35)
    base = sentence(rng, 200).split()
    texts = []
    for v in range(120):
        w = base.copy()
        w[rng.randrange(200)] = f"x{v}"
        texts.append(" ".join(w))
    monkeypatch.setattr(substring_dedup, "SPLIT", 4)
    got = dict.fromkeys(range(1, 120), 0)
    for r in substring_dedup.repeated_spans(table(spark, list(enumerate(texts)))).collect():
        got[r["doc_id"]] += r["n_words"]
    assert min(got.values()) >= 180


def test_spans_of_odd_tables(spark):
    assert substring_dedup.repeated_spans(table(spark, [])).count() == 0
    assert substring_dedup.repeated_spans(table(spark, [(1, None), (2, ""), (3, "  \n"), (None, "a b c")])).count() == 0
    text = sentence(random.Random(6), 300)
    got = substring_dedup.remove_repeats(table(spark, [(1, text), (2, text), (3, None), (4, ""), (5, "w1 " * 50_000)])).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3, 4, 5]
    assert substring_dedup.remove_repeats(table(spark, [])).count() == 0


def test_paragraphs_do_not_depend_on_what_stands_around():
    import pyarrow as pa

    from lodegrain.llm.kernels import Words, buffers

    rng = random.Random(9)
    passage = sentence(rng, 80)
    cut = []
    for _ in range(2):
        text = sentence(rng, 40) + " " + passage + " " + sentence(rng, 40)
        p = substring_dedup.Paragraphs(Words(*buffers(pa.array([text]))))
        w = text.split()
        cut.append({tuple(w[a:b]) for a, b in zip(p.start, p.stop)})
    assert sum(map(len, cut[0] & cut[1])) >= 40


def test_repeats_beyond_the_first_of_a_band_are_found(spark):
    """Many variants of a line come first, which resemble it too little; verbatim repeats of one of them still go."""
    import pyarrow as pa

    from lodegrain.llm.kernels import Words, buffers

    rng = random.Random(21)
    docs = []
    for f in range(6):
        line = sentence(rng, 60).split()
        for v in range(60):
            text = line.copy()
            for k in range(v % 12, 60, 12):
                text[k] = f"x{f}v{v}k{k}"
            docs.append((f * 100 + v, sentence(rng, 30) + " " + " ".join(text) + " " + sentence(rng, 30)))
        docs.append((f * 100 + 90, sentence(rng, 30) + " " + " ".join(text) + " " + sentence(rng, 30)))
    cut = {}
    for r in substring_dedup.repeated_spans(table(spark, docs), least_words=1).collect():
        cut.setdefault(r["doc_id"], []).append((r["begin"], r["end"]))
    seen, repeats, lost = set(), 0, []
    for i, t in sorted(docs):
        words = Words(*buffers(pa.array([t])))
        p = substring_dedup.Paragraphs(words)
        own = [(t[words.start[x] : words.end[y - 1]], words.start[x]) for x, y in zip(p.start, p.stop, strict=True)]
        for content, at in own:
            if content in seen:
                repeats += 1
                if not any(x <= at < y for x, y in cut.get(i, [])):
                    lost.append((i, content))
        seen |= {content for content, _ in own}
    assert repeats > 20 and not lost


def test_links_have_the_components_of_all_pairs():
    rng = random.Random(22)
    for size in (5, 12, 40, 90):
        base = [rng.randrange(10**6) for _ in range(60)]
        texts = []
        for _ in range(size):
            w = list(rng.choice(texts)) if texts and rng.random() < 0.5 else base.copy()
            for _ in range(rng.randrange(1, 3)):
                w[rng.randrange(len(w))] = rng.randrange(40)
            texts.append(w[: rng.randrange(56, 61)])
        sets = substring_dedup.shingle_sets(np.concatenate([np.array(w, np.uint32) for w in texts]), np.append(0, np.cumsum([len(w) for w in texts])))

        def parts(links):
            root = list(range(size))
            for _ in range(size):
                for a, b in links:
                    root[a] = root[b] = min(root[a], root[b])
            return root

        every = [(i, j) for i in range(size) for j in range(i) if substring_dedup.alike(sets[i], sets[j])]
        assert (every or size == 5) and parts(every) == parts(substring_dedup.linked(sets))


def test_cutting():
    assert substring_dedup.cut_spans("é one two three", [(3, 7)]) == "é two three" and substring_dedup.cut_spans("a b", [(2, 3)]) == "a"


# --- decontamination ------------------------------------------------------------------------------------


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers_is_the_edit_distance():
    rng = random.Random(3)
    for _ in range(150):
        p, t = ("".join(rng.choices("abc", k=rng.randrange(1, n))) for n in (12, 30))
        d = distance(p, t)
        got = decontaminate.myers(p, t, len(p))
        assert (got[0] if got else len(p)) == d and (decontaminate.myers(p, t, d - 1) is None if d else True)


def test_items_within_the_budget_are_found(spark):
    rng = random.Random(5)
    items = [(i, sentence(rng, 20)) for i in range(5)] + [(5, "short one"), (6, None), (7, ""), (8, None)]
    docs = [(i, sentence(rng, 60)) for i in range(8)]
    docs[1] = (1, docs[1][1] + " " + items[0][1].upper() + "! " + docs[1][1])
    docs[2] = (2, "x " + items[1][1].replace(" ", ", ")[:-2] + " y")
    docs[3] = (3, "so short one is " + docs[3][1])
    docs[4] = (4, items[2][1][:20] + " " + items[3][1][40:])
    docs += [(20, None), (21, "")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("_key", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_contamination(table(spark, docs), bench, block_items=2).collect()}
    want = {}
    for d, t in docs:
        for i, x in items:
            p, flat = decontaminate.normalise(x), decontaminate.normalise(t)
            if p and flat and (k := distance(p, flat)) <= decontaminate.budget(len(p)):
                want[d, i] = k
    assert got == want and {(1, 0), (2, 1), (3, 5)} <= set(got)
    clean = decontaminate.decontaminate(table(spark, docs), bench)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want} and set(CLASHING) <= set(clean.columns)
    # rows are judged, not keys
    same = table(spark, [(None, docs[1][1]), (None, "clean"), (9, docs[1][1]), (9, "clean"), (9, None)])
    assert sorted(((r["doc_id"], r["text"]) for r in decontaminate.decontaminate(same, bench, block_items=2).collect()), key=str) == [(9, "clean"), (9, None), (None, "clean")]
    assert decontaminate.decontaminate(same, bench.limit(0)).count() == 5 and decontaminate.decontaminate(same.limit(0), bench).count() == 0
    assert decontaminate.find_contamination(table(spark, []), bench).count() == 0 and decontaminate.find_contamination(table(spark, docs), bench.limit(0)).count() == 0


def test_items_of_one_word_take_nothing(spark):
    docs = [(i, f"The {sentence(random.Random(i), 8)}") for i in range(20)]
    bench = spark.createDataFrame([(0, "The"), (1, " -- "), (2, None), (3, docs[4][1])], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(table(spark, docs), bench).collect()) == [i for i in range(20) if i != 4]
    assert {r["item_id"]: r["words"] for r in decontaminate.short_items(bench).collect()} == {0: 1, 1: 0, 2: 0}
    assert decontaminate.find_contamination(table(spark, docs), bench, least_words=1).where("item_id = 0").count() == 20


def test_a_piece_that_a_long_text_repeats():
    """Ranges that were verified are looked up, not scanned."""
    item = decontaminate.normalise("a b a b a b a b " * 8 + "the end of it")
    matcher = decontaminate.Matcher([((1,), item)])
    text = decontaminate.normalise("a b a b x " * 60_000)
    began = time.perf_counter()
    assert matcher.find(text) == {} and matcher.find(text + item[1:])[0][0] == 0
    assert time.perf_counter() - began < 60
    rng = random.Random(1)
    begins, stops, held = [], [], []
    for _ in range(400):
        a = rng.randrange(1000)
        b = a + rng.randrange(1, 80)
        inside = any(x <= a and b <= y for x, y in held)
        assert decontaminate._covered(begins, stops, a, b) == inside
        if not inside:
            decontaminate._enter(begins, stops, a, b)
            held.append((a, b))
