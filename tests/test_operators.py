"""Golden and edge cases of the library's own operators (values: FIXTURES.md)."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import char_cosine, ngrams, signif, squish
from plumbline.operators import affiliations, companies, density, emotion, graph, layout, neighbours, plotdata, rca, terms, topics
from plumbline.plans import star
from plumbline.sources import patents


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_text_functions(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(ngrams(F.col("t"), 0, 2)).collect()] == [["a", "b", "c", "a b", "b c"], [], []]
    one = spark.range(1)
    assert one.select(squish(F.lit(" a\t b\n"))).first()[0] == "a b"
    assert [one.select(signif(F.lit(x))).first()[0] for x in (0.0, 123456.0, -0.00123456)] == [0.0, 123000.0, -0.00123]
    assert one.select(char_cosine(F.lit(""), F.lit("a"))).first()[0] is None
    assert one.select(char_cosine(F.lit("ab"), F.lit("ba"))).first()[0] == pytest.approx(1.0)


def test_affiliations(spark):
    df = spark.createDataFrame(
        [("2-s2.0-12345", "Utrecht University, Utrecht, Netherlands;\n   University of Oxford, Oxford, United Kingdom"), ("e2", "Solo Inst."), ("e3", None), ("e4", "A, B, C.; ")],
        "EID string, Affiliations string",
    )
    assert rows(affiliations.split_affiliations(df)) == [
        ("2-s2.0-12345", "Utrecht University, Utrecht, Netherlands", "Utrecht University", "Netherlands"),
        ("2-s2.0-12345", "University of Oxford, Oxford, United Kingdom", "University of Oxford", "United Kingdom"),
        ("e2", "Solo Inst", "Solo Inst", None),
        ("e3", None, None, None),
        ("e4", "A, B, C", "A", "C"),
        ("e4", "", "", None),
    ]
    with pytest.raises(ValueError):
        affiliations.split_affiliations(df.drop("EID"))


def test_company_names(spark):
    names = ["Delft University of Technology", "Technische Universiteit Delft", "Royal Philips", "Philips Research B.V.", "B.V. Philips Research"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, company string")
    got = {r["Initial_name"]: (r["Clean"], r["Clean2"], r["Matched"]) for r in companies.clean_and_match_companies(df, "company", 0.8, "id").collect()}
    assert got[names[0]] == ("delft univ of tech", "delft of tech univ", names[1])
    assert got[names[2]] == ("royal philips", "philips royal", None)
    assert got[names[3]] == ("philips tech", "philips tech", names[4])
    odd = spark.createDataFrame([(None,), ("",), ("...",), ("Foo NVIDIA",), ("x Inc",), ("université",)], "company string")
    clean = {r["Initial_name"]: r["Clean"] for r in companies.clean_and_match_companies(odd, "company").collect()}
    assert clean["Foo NVIDIA"] == "foo idia" and clean["x Inc"] == "x" and clean["université"] == "univ" and clean[None] is None
    assert rows(companies.clean_and_match_companies(odd.limit(0), "company")) == []


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_company_matches_over_many_ranges(spark, adaptive):
    """Rows at the borders of ranges are compared with the first row of the next range, as one global order has it."""
    names = [f"{'abc'[k % 3]}{k:04d} {'xyz'[k * 7 % 3]}{k % 11}" for k in range(3000)]
    df = spark.createDataFrame(list(enumerate(names)), "id int, company string").repartition(5)
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = {r["Initial_name"]: r["Matched"] for r in companies.clean_and_match_companies(df, "company", 0.0, "id").collect()}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    order = sorted(range(3000), key=lambda k: (" ".join(sorted(names[k].split())), k))
    assert got == {names[k]: (names[order[i + 1]] if i + 1 < 3000 else None) for i, k in enumerate(order)}


def test_results_are_ordered(spark):
    df = spark.createDataFrame([(3, "b c"), (1, "c a"), (2, "a b"), (4, None)], "id int, company string")
    assert [r["Clean2"] for r in companies.clean_and_match_companies(df, "company").collect()][-3:] == ["a b", "a c", "b c"]
    docs = spark.createDataFrame([(k, k % 2, f"w{k} w{k} common common w{k % 3}") for k in range(6)], "doc_id int, cluster int, text string")
    found = [(r["topic"], r["rank"], -r["tfidf"]) for r in terms.topic_tfidf(docs, min_char=1, min_term_freq=1).collect()]
    assert found == sorted(found) and len(found) > 4
    found = [(r["topic"], -r["c_tf_idf"], r["term"]) for r in terms.topic_terms(docs, topic_col="cluster", min_term_freq=1).collect()]
    assert found == sorted(found) and len(found) > 4


def test_rules_that_need_texts(spark):
    """The texts that a rule needs leave out no name that it matches."""
    assert companies.needed_texts("ALL", ["akzo", "nobel|novel"]) in (["akzo"], ["nobel", "novel"]) and companies.needed_texts("ANY", ["x.y", "hu"]) is None
    assert companies.needed_texts("ANY", [r"\bloo\b", "^Hee"]) == ["loo", "hee"] and companies.needed_texts("ALL", ["a+"]) is None
    rules = [r for r in companies.usable_rules(companies.builtin_rules(), strict=False)]
    for kind, tokens, _, _ in rules:
        needed = companies.needed_texts(kind, tokens)
        for name in (" ".join(re.sub(r"\\b|[\\^$().?*]", "", t.split("|")[k % len(t.split("|"))]) for t in tokens) for k in range(2)):
            hit = (all if kind == "ALL" else any)(re.search(t, name, re.I) for t in tokens)
            assert not hit or needed is None or any(x in name.lower() for x in needed), (tokens, name)


def test_rules_are_looked_up(spark):
    """The look-up leaves out no rule whose texts a name holds, names none that it lacks, and names are resolved by many tasks."""
    needed = [["akzo"], ["hu", "b"], None, ["nobel", "novel"], ["", "zz"][1:]]
    by_start, always = companies.anchors(needed)
    for name in ("akzo novel", "hubble", "x", "", "jazz", "nov", "the huzz"):
        may = companies.possible(name, by_start, always)
        assert 2 in may and may == sorted(may) and {k for k, texts in enumerate(needed) if texts and any(x in name for x in texts)} <= set(may)
    assert companies.possible("x", by_start, always) == [2]
    df = spark.range(200).selectExpr("concat('Customer ', id) AS name")
    found = companies.apply_company_rules(df, "name", companies.load_company_rules(spark), strict=False)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_rule_file(spark, tmp_path):
    path = tmp_path / "rules.jsonl"
    path.write_text(json.dumps({"priority": 2, "type": "ANY", "tokens": ["acme"], "canonical": "Acme"}) + "\n" + json.dumps({"priority": 1, "type": "ALL", "tokens": ["acme", "labs"], "pattern": "^the", "canonical": "Acme Labs"}))
    rules = companies.load_company_rules(spark, str(path))
    df = spark.createDataFrame([("The Acme Labs",), ("Acme Labs",), ("ACME ſ",)], "name string")
    assert dict(rows(companies.apply_company_rules(df, "name", rules))) == {"The Acme Labs": "Acme Labs", "Acme Labs": "Acme", "ACME ſ": "Acme"}
    path.write_text(json.dumps({"priority": 2, "type": "ANY", "tokens": ["acme"]}))
    with pytest.raises(ValueError):
        companies.load_company_rules(spark, str(path))


def test_company_rules(spark):
    rules = spark.createDataFrame([(1, "ALL", ["akzo", "nobel|novel"], None, "Akzo", 1), (2, "ALL", ["HUAWEI"], None, "Huawei", 2), (24, "ANY", ["hu", "hogeschool utrecht"], None, "HU", 3)], companies.RULE_SCHEMA)
    df = spark.createDataFrame([("Huawei Tech",), ("AKZO NOVEL NV",), ("none",), (None,), ("HU",)], "name string")
    assert dict(rows(companies.apply_company_rules(df, "name", rules))) == {"Huawei Tech": "Huawei", "AKZO NOVEL NV": "Akzo", "none": None, None: None, "HU": "HU"}
    broken = spark.createDataFrame([(1, "ALL", ["(", "x"], None, "Broken", 1)], companies.RULE_SCHEMA)
    with pytest.raises(ValueError):
        companies.apply_company_rules(df, "name", broken)
    assert companies.apply_company_rules(df, "name", broken, strict=False).where("canonical is not null").count() == 0
    assert companies.load_company_rules(spark).count() == 399


def test_rca(spark):
    data = [("A", "H04W", "North"), ("A", "G06F", "North"), ("A", "H04W", "South"), ("B", "A61K", "South"), ("B", "A61K", "North"), ("C", "G06F", "North")]
    want = {("North", "A61K"): 0.7, ("North", "G06F"): 1.4, ("North", "H04W"): 0.7, ("South", "A61K"): 1.75, ("South", "H04W"): 1.75}
    for given in (data, data + data[:2]):
        got = rca.rca_fractional(spark.createDataFrame(given, "id string, ipc string, region string")).collect()
        assert {(r["Region"], r["IPC"]): round(r["RCA"], 6) for r in got} == want


def test_topic_tfidf(spark):
    df = spark.createDataFrame(
        [("d1", 1, "energy system panel"), ("d2", 1, "module energy"), ("d3", 2, "wind turbine energy production"), ("d4", 3, ""), ("d5", 3, None)], "doc_id string, cluster int, text string"
    )
    full = {(r["topic"], r["term"]): (r["n"], r["n_topics_with_term"], round(r["tfidf"], 6)) for r in terms.topic_tfidf(df, min_term_freq=1).collect()}
    assert full["1", "energy"] == (2, 2, 2.0) and full["1", "panel"] == (1, 1, 1.405465) and full["2", "energy"] == (1, 2, 1.0)
    least = {(r["topic"], r["term"]) for r in terms.topic_tfidf(df).collect()}
    assert least == {("1", "energy"), ("2", "energy"), ("2", "production"), ("2", "turbine"), ("2", "wind")}


def test_term_counts(spark, monkeypatch):
    """As counted one by one, over several pieces of a batch; keys of sets, nulls and long runs included, and no term leaves a batch uncounted."""
    monkeypatch.setattr(terms, "TOKENS", 50)
    rng = np.random.default_rng(3)
    data = [([("a",), (None,)] if k % 3 else [("b",)], None if k % 11 == 5 else [f"w{v}" for v in rng.integers(0, 4, k % 9)]) for k in range(120)]
    df = spark.createDataFrame(data, "key array<struct<topic: string>>, words array<string>").coalesce(1)
    tf, docs = {}, {}
    for key, words in data:
        seen = [""] if words else []
        seen += ["_".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)] if words else []
        for t in seen:
            tf[str(key), t] = tf.get((str(key), t), 0) + 1
        for t in set(seen):
            docs[str(key), t] = docs.get((str(key), t), 0) + 1
    out = terms.term_counts(df, "key", "words", 1, 3, "_", mark=True)
    got = out.collect()
    assert {(str([tuple(t) for t in r["key"]]), r["term"]): (r["tf"], r["docs"]) for r in got} == {k: (v, docs[k]) for k, v in tf.items()} and len(got) == len(tf)
    named = terms.term_counts(spark.createDataFrame([(None, ["x"]), ("", ["x", "x"]), ("{}", None)], "key string, words array<string>"), "key", "words", 0, 1)
    assert sorted(map(str, rows(named))) == ["('', 'x', 2, 1)", "(None, 'x', 1, 1)"]


def test_topic_terms(spark):
    tags = {"d1": "solar energy system photovoltaic panel", "d2": "photovoltaic module sustainable energy", "d3": "wind turbine offshore energy production"}
    df = spark.createDataFrame([(d, 1 if d != "d3" else 2, t) for d, t in tags.items()], "doc_id string, topic int, text string")
    got = {(r["topic"], r["term"]): r for r in terms.topic_terms(df, max_ngram=1, min_term_freq=1).collect()}
    r = got[1, "energy"]
    assert (r["tf"], r["total_tf_topic"], r["df_corpus"], r["tf_corpus"], r["n_topics_with_term"], r["n_docs_in_topic"]) == (2, 9, 3, 3, 2, 2)
    assert round(r["tf_idf"], 6) == -0.575364 and round(r["c_tf_idf"], 6) == -0.405465 and round(r["lift"], 6) == 1.037037
    assert round(got[2, "wind"]["lift"], 6) == 2.8


def test_graph(spark):
    nodes = spark.createDataFrame([(k,) for k in range(1, 40)], "id int")
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 12)] + [(20 + k, 21 + k) for k in range(11)] + [(39, 39), (None, 3)], "src int, dst int")
    labels = dict(rows(graph.connected_components(graph.Graph(nodes, edges))))
    assert {labels[k] for k in range(1, 13)} == {1} and {labels[k] for k in range(20, 32)} == {20} and labels[39] == 39
    giant = graph.giant_component(graph.Graph(nodes, edges))  # a tie in size: the smallest id wins
    assert sorted(r[0] for r in giant.vertices.collect()) == list(range(1, 13)) and giant.edges.count() == 11
    assert graph.giant_component(graph.Graph(nodes.limit(0), edges.limit(0))).vertices.count() == 0


def test_local_stars(spark, monkeypatch):
    """A task's many edges among few ids become one an id, with the same components, however they come in pieces."""
    monkeypatch.setattr(graph, "EDGES", 300)
    rng = np.random.default_rng(5)
    pairs = [(f"n{g}-{a}", f"n{g}-{b}") for g in range(6) for a, b in rng.integers(0, 40, (400, 2)).tolist()]
    edges = spark.createDataFrame(pairs, "u string, v string").coalesce(1)
    stars = rows(graph.local_stars(edges))
    ids = {x for p in pairs for x in p}
    assert len(stars) <= 2 * len(ids)
    for given in (pairs, stars):
        label = {x: x for x in ids}
        for _ in range(20):
            for a, b in given:
                label[a] = label[b] = min(label[a], label[b])
        want = label if given is pairs else want
        assert label == want
    assert {k: v for k, v in rows(graph.linked_components(edges))} == want


def test_knn(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.1, 1.0])], "doc_id bigint, embedding array<double>")
    near = {r["id"]: r["neighbour"] for r in neighbours.knn(df, 1).collect()}
    assert near == {1: 2, 2: 1, 3: 4, 4: 3}
    assert {(r["id"], r["neighbour"]) for r in neighbours.knn(df, 1, block=1).collect()} == set(near.items())


@pytest.mark.parametrize("metric,kind", [("cosine", "float"), ("cosine", "double"), ("euclidean", "double")])
def test_knn_over_many_blocks(spark, metric, kind):
    """As brute force has it, copies included; a block keeps its best and no candidates of block pairs are shuffled or sorted."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 6)).astype(np.float32).astype(float)
    x[300:350] = x[100:150]
    x[350] = 0
    df = spark.createDataFrame([(k * 3, v.tolist()) for k, v in enumerate(x)], f"doc_id bigint, embedding array<{kind}>")
    found = neighbours.knn(df, 5, metric=metric, block=90)
    got = {(r["id"], r["rank"]): (r["neighbour"], r["distance"]) for r in found.collect()}
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    d = np.array([1 - np.einsum("ij,ij->i", np.broadcast_to(u, unit.shape), unit) for u in unit]) if metric == "cosine" else np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    best = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert {k: v[0] for k, v in got.items()} == {(3 * a, r + 1): 3 * int(b) for a in range(700) for r, b in enumerate(best[a])}
    assert all(v[1] == pytest.approx(d[a // 3, best[a // 3, r - 1]], abs=1e-12) for (a, r), v in got.items())
    assert "Window" not in found._jdf.queryExecution().toString()


def planted(n=40, size=8, seed=0):
    """Three groups of directions, and two vectors far from all."""
    rng = np.random.default_rng(seed)
    base = np.eye(size)[:3]
    x = np.concatenate([b + rng.normal(0, 0.02, (n, size)) for b in base] + [10 * np.eye(size)[4:5], -10 * np.eye(size)[5:6]])
    return x, np.array([1] * n + [2] * n + [3] * n + [0, 0])


def test_pca_and_layout():
    x, truth = planted()
    y = layout.pca(x, 4)
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred)
    want = np.abs(centred @ vectors[:, np.argsort(-values)[:4]])
    assert np.abs(y) == pytest.approx(want, abs=1e-8)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :10]
    z = layout.umap(x, near, np.take_along_axis(d, near, 1), 2, 42)
    own = np.array([np.sqrt(((z[truth == c] - z[truth == c].mean(axis=0)) ** 2).sum(axis=1)).mean() for c in (1, 2, 3)])
    centres = np.array([z[truth == c].mean(axis=0) for c in (1, 2, 3)])
    apart = min(np.sqrt(((centres[a] - centres[b]) ** 2).sum()) for a, b in ((0, 1), (0, 2), (1, 2)))
    assert apart > 2 * own.max() and (z == layout.umap(x, near, np.take_along_axis(d, near, 1), 2, 42)).all()
    i, j, w = layout.fuzzy_graph(near, np.take_along_axis(d, near, 1))
    pairs = {(a, b): c for a, b, c in zip(i.tolist(), j.tolist(), w.tolist(), strict=True)}
    assert all(pairs[b, a] == pytest.approx(c) and -1e-9 <= c <= 1 + 1e-9 for (a, b), c in pairs.items())


def test_spanning_tree_and_clusters():
    x, truth = planted(15)
    n, k = len(x), 5
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, k - 1]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    edges = sorted((reach[a, b], a, b) for a in range(n) for b in range(a))  # Kruskal by brute force
    group, total = [*range(n)], 0.0
    for w, a, b in edges:
        if group[a] != group[b]:
            total += w
            old, new = group[a], group[b]
            group = [new if g == old else g for g in group]
    _, _, weights = density.spanning_tree(x, k)
    assert len(weights) == n - 1 and weights.sum() == pytest.approx(total)
    label, strength = density.hdbscan(x, k)
    assert (label[truth > 0] == truth[truth > 0]).all() and (label[truth == 0] == 0).all() and (strength[label == 0] == 0).all()
    share = density.soft_membership(x, label, k)
    assert share.sum(axis=1) == pytest.approx(np.ones(n)) and (share.argmax(axis=1)[label > 0] + 1 == label[label > 0]).all()
    for p in np.flatnonzero(label == 0):
        least = [reach[p, label == c].min() for c in (1, 2, 3)]
        assert share[p] == pytest.approx((1 / np.array(least)) / (1 / np.array(least)).sum())
    assert (density.assign_all(x, label, k) > 0).all() and (density.assign_all(x, np.zeros(n, int), k) == 0).all()


@pytest.mark.parametrize("n,size", [(700, 2), (700, 9)])
def test_tree_and_shares_without_all_pairs(n, size):
    """Prim over all pairs has the same edges in the same order, with the neighbours given or not."""
    x = np.random.default_rng(size).normal(size=(n, size)) * np.where(np.arange(n) % 3, 1, 5)[:, None]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for k in (2, 6):
        core = np.sort(d, axis=1)[:, k - 1]
        reach = np.maximum(np.maximum(d, core[:, None]), core[None])
        best, parent, left, at, want = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool), 0, []
        for _ in range(n - 1):
            left[at] = False
            closer = left & (reach[at] < best)
            best[closer], parent[closer] = reach[at][closer], at
            at = int(np.argmin(np.where(left, best, np.inf)))
            want.append((parent[at], at, best[at]))
        near, far = density.nearest(x, k + 3)
        for got in (density.spanning_tree(x, k), density.spanning_tree(x, k, near, far)):
            assert [*zip(*(v.tolist() for v in got), strict=True)] == want
        label, _ = density.hdbscan(x, k)
        least = np.array([[reach[p, label == c].min() for c in range(1, label.max() + 1)] for p in range(n)]).reshape(n, -1)
        assert (density.assign_all(x, label, k) == np.where(label > 0, label, least.argmin(axis=1) + 1 if label.any() else 0)).all()


def test_topics_of_planted_groups(spark):
    x, truth = planted()
    docs = spark.createDataFrame([(k, f"text {k}", v.tolist()) for k, v in enumerate(x)], "doc_id bigint, text string, embedding array<double>")
    for reducer in ("umap", "pca"):
        found = topics.identify_topics(docs, n_components=3, reducer=reducer, assign_by_membership=True)
        label = {r["doc_id"]: r["cluster"] for r in found.documents.collect()}
        assert len({label[k] for k in range(120)}) == 3 and all(len({label[k] for k in range(40 * g, 40 * g + 40)}) == 1 for g in range(3)) and min(label.values()) > 0
        assert found.coordinates.columns == ["doc_id", "dim_1", "dim_2", "dim_3", "cluster"] and found.coordinates.count() == len(x)
    grid = topics.identify_topics_grid(docs, {"given": None}, [10, 15], [2], [5], reducer="pca").collect()
    assert [(r["n_neighbors"], r["n_topics"]) for r in grid] == [(10, 3), (15, 3)] and all(r["perc_outliers"] == r["n_outliers"] / len(x) for r in grid)
    few = topics.identify_topics(docs.limit(3), n_components=4)  # fewer documents than components are laid out all the same
    assert few.documents.count() == 3 and {r["cluster"] for r in few.documents.collect()} == {0}
    one = topics.identify_topics(docs.limit(1))
    assert one.documents.count() == 1
    with pytest.raises(ValueError):
        topics.reduce_vectors(docs, reducer="none")


def test_encoders_taggers_and_scorers(spark):
    df = spark.createDataFrame([(1, "Good river"), (2, None)], "doc_id bigint, text string")
    vectors = rows(topics.embed(df, topics.model_encoder(lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))))
    assert vectors == [(1, [10.0, 1.0]), (2, [0.0, 1.0])]
    length = [sum(v * v for v in r["embedding"]) for r in topics.embed(df).collect()]
    assert length == pytest.approx([1.0, 0.0])
    tagger = terms.model_tagger(lambda: lambda texts: [[{"pos": k + 1, "token": w, "lemma": w.lower() + "s", "upos": "NOUN" if w[0].islower() else "ADJ"} for k, w in enumerate(t.split())] for t in texts])
    got = terms.topic_tfidf(df.withColumn("cluster", F.lit(1)), tagger=tagger, min_term_freq=1).collect()
    assert [r["term"] for r in got] == ["rivers"]


def test_emotion(spark):
    df = spark.createDataFrame([("AeI b!",), (None,), ("",)], "text string")
    got = rows(emotion.predict_vad(df))
    assert got[0][1] == pytest.approx(0.75) and got[0][2] == pytest.approx(0.5) and got[1][1:] == (0.0, 0.0, 0.0)


def test_plots(spark):
    df = spark.createDataFrame([("t", "a", 3.0), ("t", "b", 2.0), ("t", "c", 2.0), ("t", "d", 1.0)], "topic string, word string, score double")
    assert [(r["word"], r["panel_order"]) for r in plotdata.top_topic_words(df, n_words=2).collect()] == [("a", 3), ("b", 2), ("c", 1)]
    grid, columns = plotdata.topic_terms_grid(df.withColumnsRenamed({"word": "term", "score": "tfidf"}), n_terms=2)
    assert sorted(r["term"] for r in grid.collect()) == ["a", "b"] and columns == 1
    space = spark.createDataFrame([(1, 0.0, 0.0, 0), (2, 1.0, 2.0, 1), (3, 3.0, 4.0, 1)], "doc_id bigint, dim_1 double, dim_2 double, cluster int")
    points, centres = plotdata.topic_space(space, topic_labels={1: "one"})
    assert {r["topic_label"] for r in points.collect()} == {"Noise", "Topic 1: one"}
    assert rows(centres) == [("Topic 1: one", 1, 2.0, 3.0, 2)]


def test_patents(spark, tmp_path):
    title = {"a": [{"lang": "fr", "text": "F"}, {"lang": "en", "text": "E"}], "b": {"lang": "de", "text": "D"}, "c": [{"lang": "fr"}, {"lang": "de", "text": "X"}], "d": [{"lang": "fr", "text": "F"}]}
    lines = [json.dumps({"lens_id": k, "biblio": {"invention_title": t}}) for k, t in title.items()]
    lines += ["{bad", "", json.dumps({"lens_id": "e", "biblio": None})]
    lines.append(json.dumps({"lens_id": "f", "biblio": {"parties": {"inventors": [{"sequence": 7, "extracted_name": {"value": "I1"}}, {}]}, "classifications_ipcr": {"classifications": [{}]}}}))
    path = tmp_path / "p.jsonl"
    path.write_text("\n".join(lines))
    read = patents.read_lines(spark, str(path))
    info = {r["lens_id"]: r for r in patents.patent_info(read).collect()}
    assert {k: info[k]["title"] for k in "abcde"} == {"a": "E", "b": "D", "c": None, "d": "F", "e": None}
    assert info["f"]["ipc_classifications"] == "" and info["a"]["ipc_classifications"] is None and info["a"]["cited_by_count"] == 0
    assert rows(patents.inventors(read).select("sequence", "name")) == [(7, "I1"), (2, None)]
    assert patents.applicants(read).count() == 0 and patents.bad_records(read).count() == 2
    assert patents.patent_info(patents.read_lines(spark, str(path), max_records=6)).count() == 4


def test_patents_are_parsed_once(spark):
    """Behind a join too, and each array is taken out of a record once."""
    lines = [(1, '{"lens_id": "a", "biblio": {"parties": {"applicants": [{"residence": "X"}, {"extracted_name": {"value": "N"}}]}}}'), (2, "[1]"), (3, ' \t{}'), (4, None), (5, "3"), (6, "{bad"), (7, '"{}"')]
    df = spark.createDataFrame(lines, "k int, value string").join(spark.range(1, 9).withColumnRenamed("id", "k"), "k").select("value")
    info = patents.patent_info(df, addresses=True)
    assert sorted(map(str, rows(info.select("lens_id", "applicants", "applicant_addresses", "applicant_countries")))) == ["('a', 'N', None, 'X')", "(None, None, None, None)"]
    assert sorted(map(str, rows(patents.bad_records(df)))) == sorted(map(str, [("[1]",), (None,), ("3",), ("{bad",), ('"{}"',)]))
    plan = info._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("$.biblio.parties.applicants") == 1 and plan.count("$.biblio.parties.inventors") == 1


def test_first_records_of_many_files(spark):
    """All records are written in order, by as many tasks as there are ranges; the first lines are those of the first files."""
    lines = spark.range(4000).repartition(7).orderBy("id").selectExpr("concat('{\"lens_id\": \"', id, '\"}') AS value")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        path = star._files(spark, lines, compression="gzip")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    read = spark.read.text(path)
    assert read.count() == 4000 and read.select("_metadata.file_path").distinct().count() > 1
    assert [r["lens_id"] for r in patents.patent_info(patents.read_lines(spark, path, max_records=1500)).collect()] == [str(k) for k in range(1500)]
