"""op4, op5, op6, op8 and the pipeline: brute force, held-out accuracy, planted cases and odd input."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate, language_id, near_dup, quality
from shelfmark.llm.queries import QUERIES

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "l")]


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text):
    w = words_of(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent):
    """{row number: smallest id of its component}."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[root(a)] = root(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[root(k)].append(i)
    least = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return [least[root(k)] if sets[k] else rows[k][0] for k in range(len(rows))]


def planted(n=60, seed=3):
    """Texts with groups of near copies of all kinds, copies, and odd ones."""
    rng = random.Random(seed)
    text = lambda k: [rng.choice(WORDS) for _ in range(k)]
    rows = [""] * 2 + [None, " \t\n", "one", "ONE", "one two three", "a b c d e", "x " * 40]
    shared = text(30)
    for _ in range(n):
        base = text(rng.randint(20, 160))
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append(rng.choice([" ", "\n"]).join(copy))
        rows.append(" ".join(base + shared))
    base = text(150)
    for _ in range(80):
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        rows.append(" ".join(copy).upper() if rng.random() < 0.1 else " ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(3, rows[10]), (None, rows[11]), (None, "only null ids here, of all rows there are")]


@pytest.mark.parametrize("percent,small", [(85, near_dup.SMALL), (80, 3)])
def test_near_duplicates(spark, percent, small):
    rows = planted()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df, percent, small=small).collect()), key=str)
    comp = brute_components(rows, percent)
    want = sorted(((i, len(shingles(t)), c, i is not None and i == c) for (i, t), c in zip(rows, comp, strict=True)), key=str)
    assert got == want


def test_near_duplicates_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    assert sorted(map(tuple, near_dup.near_duplicates(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True)]


def test_shingle_hashes():
    for text in ("a b c d e f", "a  b\tc\nd e", "x " * 9, "é ü a b c d", "one"):
        assert len(near_dup.shingle_set(text.encode())) == len(shingles(text))
    a, b = ("p q r s t u v w".encode(), "q r s t u v w z".encode())
    assert len(np.intersect1d(near_dup.shingle_set(a), near_dup.shingle_set(b))) == 3


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert len(found) == docs.count() and np.mean([r.lang == r.lang_pred for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_language_odd(spark):
    rows = [(1, "der die das und", "de", 1), (2, "the of and to", "en", 1), (3, None, "en", 1), (4, "", None, 1), (5, "123 !!", "en", 1), (6, "the and of THE", None, 1), (6, "the and of THE", None, 1), (None, "und das", None, 1)]
    df = spark.createDataFrame([(i, t, g, k) for i, t, g, k in rows for _ in range(2)], "doc_id long, text string, lang string, score int")
    model = language_id.fit(df, df.doc_id.isNotNull())
    got = Counter((r.doc_id, r.lang_pred) for r in language_id.identify(df, model).collect())
    assert got == {(1, "de"): 2, (2, "en"): 2, (3, "und"): 2, (4, "und"): 2, (5, "und"): 2, (6, "en"): 4, (None, "de"): 2}
    empty = language_id.fit(df.limit(0), df.doc_id.isNotNull())
    assert {r.lang_pred for r in language_id.identify(df, empty).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).count() == 0


def test_backoff_is_longest_first():
    v = lambda x: np.array([x], np.float32)
    model = language_id.Model(["xx"], {"known": v(-1)}, [{}, {"a": v(-9)}, {"ab": v(-5)}, {}, {"abcd": v(-2)}])
    assert model.word("known")[0] == -1 and model.word("abcd")[0] == -2 and model.word("abx")[0] == -5 and model.word("a")[0] == -9 and model.word("z")[0] == 0


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = QUERIES["op6_quality"](spark, sf)
    held = found.join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([(r.predicted == 1) == (r.quality == 1) for r in held]) >= 0.95
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_quality_odd(spark):
    df = spark.createDataFrame([(1, "Good words here, and there."), (2, "$$$ ### %%%"), (3, None), (4, ""), (None, "Good words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None), (9, 1)], "doc_id long, quality int")
    model = quality.fit(df, labels, labels.doc_id.isNotNull())
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert len(got) == 5 and got[1] > 0.9 and got[2] < 0.1 and all(0 <= s <= 1 for s in got.values())
    untrained = quality.fit(df, labels.limit(0), labels.doc_id.isNotNull())
    assert {r.score for r in quality.score(df, untrained).collect()} == {0.5}
    assert quality.score(df.limit(0), model).count() == 0


def test_letters_by_category(spark):
    rows = [(1, "une ligne", "fr"), (2, "½ ² Ⅷ 12 —", None), (3, None, None), (4, "", None), (5, "½ une", None)]
    df = spark.createDataFrame([(i, f"{t} {t}" if t else t, g) for i, t, g in rows], "doc_id long, text string, lang string")
    model = language_id.fit(df, df.doc_id.isNotNull())
    assert {r.doc_id: r.lang_pred for r in language_id.identify(df, model).collect()} == {1: "fr", 2: "und", 3: "und", 4: "und", 5: "fr"}


def test_language_scores_against_brute_force(spark, sf):
    """Each word's score looked up by itself, n-grams and all, and added up."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(docs, docs.doc_id % 2 == 0)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}

    def word(w):
        if w in model.words:
            return model.words[w]
        for n in range(language_id.LONGEST, 0, -1):
            known = [model.grams[n][g] for g in (f" {w} "[k : k + n] for k in range(len(w) + 3 - n)) if g in model.grams[n]]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(model.langs))

    for r in docs.collect()[:60]:
        words = language_id.LETTERS.findall((r.text or "").lower())
        if not words:
            assert got[r.doc_id].lang_pred == "und"
            continue
        total = np.sum([word(w) for w in words], axis=0)
        share = np.exp((total - total.max()) * min(1, language_id.EVIDENCE / len(words)))
        assert got[r.doc_id].lang_pred == model.langs[int(np.argmax(total))]
        assert abs(got[r.doc_id].score - share.max() / share.sum()) < 1e-3


def test_samples_are_bounded(spark):
    rows = [(None if k % 2 else 7, "one and the same", "a") for k in range(4000)] + [(k, f"text {k}", "b") for k in range(3000)] + [(1, "rare", "c")]
    df = spark.createDataFrame(rows, "id long, text string, group string")
    got = Counter(r.group for r in language_id.sample(df, 100).collect())
    assert got == {"a": 2, "b": 100, "c": 1}
    assert language_id.sample(df.limit(0), 100).count() == 0


def test_quality_sample_of_repeated_ids(spark):
    rows = [(1, f"Good words, number {k}.") for k in range(5000)] + [(2, "$$$ ###")] * 50
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model = quality.fit(df, labels, labels.doc_id.isNotNull())
    assert Counter(model.labels.tolist()) == {1.0: quality.SAMPLE, 0.0: 1}


def test_votes_count_ties():
    near = np.array([[0.5] * 40 + [0.9]], np.float32)
    labels = np.array([1.0, 0.0] * 20 + [1.0])
    for order in (np.arange(41), np.random.default_rng(0).permutation(41)):
        assert abs(quality.votes(near[:, order], labels[order])[0] - (0.5 * 20 + 0.9) / (0.5 * 40 + 0.9)) < 1e-6


def test_blocked_cosine_is_exact():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(WORDS, 40)) for _ in range(50)]
    model = quality.Model(rng.standard_normal((quality.FEATURES, 8)).astype(np.float32), quality.unit(rng.standard_normal((30, 8)).astype(np.float32)), rng.integers(0, 2, 30).astype(float))
    vectors = model.latent(texts)
    for k, s in enumerate(model.score(texts)):
        near = vectors[k] @ model.vectors.T
        best = np.argsort(-near)[: quality.NEIGHBOURS]
        w = np.maximum(near[best], 0).astype(float)
        assert abs(s - (w * model.labels[best]).sum() / w.sum()) < 1e-6


def benchmark_case(seed=5):
    rng = random.Random(seed)
    text = lambda k: [rng.choice(WORDS) for _ in range(k)]
    items = [text(rng.randint(16, 50)) for _ in range(30)]
    docs, want = [], set()
    for k in range(120):
        body = text(rng.randint(0, 300))
        kind = k % 6
        i = rng.randrange(len(items))
        own = list(items[i])
        if kind == 1:  # whole
            want.add((k, i))
        elif kind == 2:  # paraphrase: some words replaced or left out
            for _ in range(len(own) // 8):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            want.add((k, i))
        elif kind == 3:  # six words, which is no contamination
            own = own[:6]
        else:
            own = []
        at = rng.randint(0, len(body))
        docs.append((k, " ".join(body[:at] + own + body[at:])))
    return docs, [(k, " ".join(w)) for k, w in enumerate(items)], want


def test_decontamination(spark):
    docs, items, want = benchmark_case()
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*r, "x") for r in [*items, (0, items[0][1]), (99, None), (98, "")]], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    assert not got - want and len(got & want) >= 0.95 * len(want)
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (None, items[0][1])], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, b).collect()] == [(None, 0)]


def test_common_subsequence():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(1)
    for _ in range(50):
        a, b = [rng.randrange(6) for _ in range(rng.randint(1, 20))], [rng.randrange(-1, 6) for _ in range(rng.randint(0, 30))]
        assert decontaminate.common_subsequence(a, b) == (slow(a, b), slow(a[-decontaminate.ANSWER_WORDS :], b))


def test_documents_of_the_tables(spark):
    """Every document that holds a whole item is found, and none that holds under a third of one."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: " " + " ".join(decontaminate.item_words(r.text)) + " " for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: " ".join(decontaminate.item_words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if f" {x} " in t}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op8_decontamination"](spark, sf).collect()}
    assert want <= got and len(got - want) <= len(want) // 10


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "MinHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
    now, ids = docs, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in now.collect()}
        now = corpus_pipeline.stored(stage(spark, now, sf), "test")
        assert now.columns == docs.columns
        after = {r.doc_id for r in now.select("doc_id").collect()}
        assert after <= set(before)
        if name == "MinHash near-dedup":
            rows = sorted(before.items())
            comp = brute_components(rows, corpus_pipeline.NEAR)
            assert after == {i for (i, _), c in zip(rows, comp, strict=True) if i == c}
    assert ids - after
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == after


def template_family(percent, seed, crowd=1300, pairs=300):
    """Rows of one template whose share is below `percent`, and which of them are pairs just above it."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    template = [word() for _ in range(196)]
    rows, near = [], []
    own = 46 if percent == 80 else 33
    for k in range(crowd):
        tail = [word() for _ in range(rng.randint(own, own + 6))]
        rows.append(" ".join(template + tail))
        if k < pairs:
            size = len(template) + len(tail) - 4
            # The last words differ: d of them leave (size - d) / (size + d) of the shingles.
            d = int(size * (1 - percent / 100) / (1 + percent / 100))
            rows.append(" ".join(template + tail[: len(tail) - d] + [word() for _ in range(d)]))
            assert 100 * (size - d) >= percent * (size + d) and len(tail) > d
            near.append((len(rows) - 2, len(rows) - 1))
    return rows, near


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_in_a_template_family(spark, percent):
    rows, near = template_family(percent, seed=percent)
    for a, b in near[:20]:
        x, y, z = shingles(rows[a]), shingles(rows[b]), shingles(rows[-1])
        assert percent <= 100 * len(x & y) / len(x | y) < percent + 2 and 100 * len(x & z) < percent * len(x | z)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    comp = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, percent).collect()}
    assert sum(comp[a] == comp[b] for a, b in near) >= 0.99 * len(near), sum(comp[a] == comp[b] for a, b in near)
    assert max(Counter(comp.values()).values()) <= 2


def test_rows_of_deeper_levels_are_made_once(spark, monkeypatch):
    rows, near = template_family(80, seed=1, crowd=150, pairs=20)
    made, seen, child_rows = [], spark.sparkContext.accumulator(0), near_dup.child_rows
    counted = F.udf(lambda cid: seen.add(1) or True, "boolean").asNondeterministic()

    def counting(*args):
        deeper = child_rows(*args)
        made.append(deeper.count())
        return deeper.filter(counted("cid"))

    monkeypatch.setattr(near_dup, "child_rows", counting)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    comp = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, 80).collect()}
    assert all(comp[a] == comp[b] for a, b in near) and len(set(comp.values())) == len(rows) - len(near)
    assert len(made) == 2 and min(made) > len(rows) and seen.value == sum(made)


@pytest.mark.parametrize("percent", [50, 70])
def test_near_duplicates_at_lower_thresholds(spark, percent):
    """Pairs just above and just below the threshold, each with words of its own."""
    rng = random.Random(percent)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    rows, above = [], []
    for k in range(120):
        size = 100
        # d shingles of each side differ: (size - d) / (size + d).
        d = int(size * (1 - percent / 100) / (1 + percent / 100)) - 1 + (3 if k % 2 else 0)
        base = [word() for _ in range(size + 4)]
        rows += [" ".join(base), " ".join(base[: len(base) - d] + [word() for _ in range(d)])]
        x, y = shingles(rows[-2]), shingles(rows[-1])
        if 100 * len(x & y) >= percent * len(x | y):
            above.append(2 * k)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), percent).collect()}
    assert 50 <= len(above) <= 70 and sum(got[k] == got[k + 1] for k in above) >= 0.98 * len(above)
    assert all(got[k] != got[k + 1] for k in range(0, len(rows), 2) if k not in above) and len(set(got.values())) >= len(rows) - len(above)


def test_each_level_of_each_tree_has_its_own_hash():
    plan = near_dup.Plan.of(85)
    assert {plan.at(t, k) for t in range(plan.trees) for k in range(plan.depth)} == set(range(plan.trees * plan.depth))
    assert plan.trees * plan.depth <= plan.hashes and 1 - (1 - 0.85**plan.depth) ** plan.trees >= near_dup.RECALL


@pytest.mark.parametrize("parts", [1, 2])
def test_tiles_are_complete(parts):
    rng = random.Random(parts)
    texts = [t for _, t in planted(20, seed=parts) if t and words_of(t)]
    sets = {near_dup.set_key(s): s for s in (near_dup.shingle_set(t.encode()) for t in texts)}
    sets = list(sets.values())
    part = [rng.randrange(parts) for _ in sets]
    like = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))

    def grouped(links):
        up = list(range(len(sets)))
        for a, b in links:
            up = [up[b] if x == up[a] else x for x in up]
        return {frozenset(k for k in range(len(sets)) if up[k] == r) for r in set(up)}

    every = [(a, b) for a in range(len(sets)) for b in range(a) if (parts == 1 or part[a] != part[b]) and like(sets[a], sets[b])]
    links = near_dup.tile_links(list(range(len(sets))), list(range(len(sets))), part, sets, 80)
    assert grouped(links) == grouped(every) and len(links) == len(sets) - len(grouped(every))


def paraphrases(lengths, seed, per=40):
    """Documents with items of which a fifth to a third of the words are others, left out or joined by more; and the items."""
    rng = random.Random(seed)
    common = [w for w in WORDS[:40]]
    text = lambda k: [rng.choice(common) if rng.random() < 0.4 else rng.choice(WORDS) + rng.choice(WORDS) for _ in range(k)]
    items = [text(n) for n in lengths for _ in range(6)]
    docs = []
    for k in range(per * len(lengths)):
        own = list(items[k % len(items)])
        for _ in range(int(len(own) * rng.uniform(0.2, 0.35))):
            at, kind = rng.randrange(len(own)), rng.random()
            if kind < 0.6:
                own[at] = rng.choice(WORDS) + rng.choice(WORDS)
            elif kind < 0.8 and len(own) > 3:
                del own[at]
            else:
                own.insert(at, rng.choice(WORDS))
        docs.append((k, " ".join(text(rng.randint(0, 200)) + own + text(rng.randint(0, 200)))))
    docs += [(len(docs) + k, " ".join(text(rng.randint(100, 400)))) for k in range(per)]
    return docs, list(enumerate(" ".join(w) for w in items))


def exhaustive(docs, items):
    """All pairs that the longest common subsequence and the answer confirm, without any search."""
    found = set()
    for i, item in items:
        own = {w: k for k, w in enumerate(dict.fromkeys(item.split()))}
        ids = [own[w] for w in item.split()]
        found |= {(d, i) for d, t in docs if decontaminate.best_stretch(ids, np.array([own.get(w, -1) for w in t.split()]))}
    return found


@pytest.mark.parametrize("lengths,least", [((18, 30, 50, 64), 0.97), ((5, 8, 10, 12, 14), 0.93), ((70, 120, 300), 0.97)])
def test_latent_search_against_exhaustive_comparison(spark, monkeypatch, lengths, least):
    docs, items = paraphrases(lengths, seed=sum(lengths))
    want = exhaustive(docs, items)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contaminated(d, b).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert len(want) > 20 * len(lengths) and got <= want and len(got) >= least * len(want), (len(got), len(want))
    # Cosine decides what is a candidate.
    words = {i: decontaminate.item_words(t) for i, t in items}
    own = decontaminate.Items.of(list(words.items()))
    terms = pa.array(list(own.terms))
    index = decontaminate.Index.of(own, np.ones(len(terms) + 1), np.eye(len(terms)))
    ids, starts = decontaminate.term_ids(pa.array([t for _, t in docs]), terms)
    counts = []
    for cosine in (0.0, 0.3, 0.6, 0.9, 9.0):
        monkeypatch.setattr(decontaminate, "COSINE", cosine)
        counts.append(len({m[:2] for m in index.matches(ids, starts)}))
    assert counts[0] == len(want) and counts == sorted(counts, reverse=True) and counts[3] < counts[0] and counts[4] == 0


def test_terms_of_texts():
    ids, starts = decontaminate.term_ids(pa.array(["The cat, (the) -- É", "", "x\u2003the"]), pa.array(["the", "é"]))
    assert ids.tolist() == [0, -1, 0, 1, -1, 0] and starts.tolist() == [0, 4, 4, 6]


def test_stretched_match_is_found_at_any_offset():
    own = list(range(20))
    # Thirteen of the words and the whole answer over 29 words, which only a window near its start holds whole.
    match = [x for k in range(8) for x in (k, -1, -1)][:-2] + list(range(13, 20))
    match = match[:1] + [-1] * (29 - len(match)) + match[1:]
    for shift in range(12):
        around = np.array([-1] * (30 + shift) + match[: len(match)] + [-1] * 40)
        assert decontaminate.best_stretch(own, around) == (15, 5)
    # A longer stretch without the answer doesn't hide a shorter one that has it.
    around = np.array([*range(15), *[-1] * 40, *range(6, 20)])
    assert decontaminate.best_stretch(own, around) == (14, 5)


def test_nearly_whole_item_needs_no_answer():
    own = list(range(50))
    assert decontaminate.best_stretch(own, np.array(own[:46] + [-1] * 30)) == (46, 1)
    assert decontaminate.best_stretch(own, np.array(own[:44] + [-1] * 30)) is None


def test_pipeline_decides_by_row(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    a, b, c, item, other = (" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(5))
    rows = [(1, a), (2, a + " end"), (2, b), (None, a), (None, c), (3, f"{c} {c} {item}"), (3, f"{b} {c} {b}"), (None, f"{b} {b} {c} {other}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(None, item), (None, other)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    same = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert same(corpus_pipeline.distinct(spark, docs, str(tmp_path))) == sorted([rows[k] for k in (0, 2, 4, 5, 6, 7)], key=str)
    assert same(corpus_pipeline.uncontaminated(spark, docs, str(tmp_path))) == sorted([rows[k] for k in (0, 1, 2, 3, 4, 6)], key=str)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, clashing columns, and empty tables, through all stages."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    table = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    docs = table("documents")
    good = docs.join(table("labels").filter("quality = 1").select("doc_id"), "doc_id").orderBy("doc_id").collect()
    long = "\n".join(r.text for r in good[:20]) * 4
    odd = [(None, good[0].text, None, None, None), (900_001, None, None, None, None), (900_002, "", "en", "s", 0), (900_003, " \n\t", None, None, 3), (900_004, "½ ² 123 !!", None, "s", 10), (900_005, long, None, "s", len(long)), (900_005, long, None, "s", len(long)), (None, None, None, None, None), (good[1].doc_id, good[2].text, "en", "s", 5)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for name in ("_found", "_score", "_row", "id", "score", "h", "key", "group", "label", "drawn"):
        rows = rows.withColumn(name, F.lit("kept"))
    folder = str(tmp_path / "odd")
    rows.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(name).write.parquet(f"{folder}/{name}.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = Counter((r.doc_id, r.text) for r in now.select("doc_id", "text").collect())
        now = corpus_pipeline.stored(stage(spark, now, folder), "odd")
        assert now.columns == columns and now.filter("_row = 'kept'").count() == now.count()
        after = Counter((r.doc_id, r.text) for r in now.select("doc_id", "text").collect())
        assert all(after[k] <= before[k] for k in after), name
        if name == "language ID":
            assert {i for i, t in before if not (t or "").strip() or i == 900_004} & {i for i, _ in after if i is not None} == set()
        if name == "MinHash near-dedup":
            assert max(after.values()) == 1 and (900_005, long) in after
            # Ids may belong to several groups here, so groups are counted by row.
            assert len(after) == len(set(brute_components([(k, x[1]) for k, x in enumerate(before)], corpus_pipeline.NEAR)))
    assert corpus_pipeline.run(spark, folder).count() == now.count()
    empty = str(tmp_path / "empty")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
