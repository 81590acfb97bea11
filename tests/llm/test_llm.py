"""The ten operators against brute force, round trips and edge cases."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat, decontaminate, jaccard, lattice, markup, mixing, quality, sharding, support, template, tokens, toxicity, vectext

LONG = "word " * 60_000  # a very long text
ODD = [(None, "alpha beta gamma delta"), (1, None), (2, ""), (3, LONG), (4, "same text here again"), (4, "same text here again"), (5, "same text here again"), (6, "   \n\t")]


def odd_names(docs):
    """docs with columns of the names that operators use themselves, and names and types that need care."""
    for name in ("_src", "__src", "_key", "__key", "_gone", "_again", "_mark", "_hash", "_target", "_copy", "key", "text_hash", "shard_at", "a`b", "c.d"):
        docs = docs.withColumn(name, F.lit("own"))
    return docs.withColumn("map", F.create_map(F.lit("k"), F.lit(1)))


def words_of(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 20)] + [(30, 31), (31, 31), (None, 4)], "u bigint, v bigint")
    got = {r[0]: r[1] for r in support.connected_components(edges).collect()}
    assert got == {k: 1 for k in range(1, 21)} | {30: 30, 31: 30}


def test_words_and_grams():
    texts = ["The cat, the CAT!", None, "", "é-b  c", "x"]
    w = vectext.words(pa.array([t or "" for t in texts]))
    assert np.diff(w.first).tolist() == [len(words_of(t)) for t in texts] and w.hash[0] == w.hash[2] and w.hash[1] == w.hash[3]
    _, first = vectext.ngram_hashes(w, 2)
    assert np.diff(first).tolist() == [3, 0, 0, 2, 1]


# --- 1 mixing ----------------------------------------------------------------------------------------------


def test_mixing_budgets(spark, docs_of):
    rng = random.Random(1)
    rows = [(k, " ".join(["word"] * rng.randint(1, 30)), "abc"[k % 3]) for k in range(200)]
    got = mixing.mixture(docs_of(rows), {"a": 3, "b": 1}, 6000).collect()
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abc"}
    for s, budget in (("a", 4500), ("b", 1500)):
        own = [r for r in got if r["source"] == s]
        assert {r["epochs"] for r in own} == {budget // size[s]}  # complete epochs first
        held = sum(r["n_tokens"] * r["repeats"] for r in own)
        assert budget - 30 < held <= budget
    assert not [r for r in got if r["source"] == "c"]


def test_mixing_cases(docs_of):
    out = mixing.mix(docs_of(ODD + [(9, "null source", None)]))
    assert out.columns == docs_of([]).columns
    ids = [r["doc_id"] for r in out.collect()]
    assert {None, 3, 4, 5, 9} <= {*ids} and ids.count(4) >= 2
    assert mixing.mixture(docs_of([])).count() == 0 and mixing.mix(docs_of([])).count() == 0


def brute_mixture(rows, seed=mixing.SEED):
    """repeats of (doc_id, source) by sorting each whole source; rows of distinct ids that aren't null."""
    import hashlib

    sources = {}
    for k, text, source in rows:
        text = text or ""
        ink = re.sub(r"[ \t\n\r]+", "", text)
        share = sum(c.isalpha() for c in ink) / len(ink) if ink else 0.0
        u = (int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        sources.setdefault(source, []).append((-math.log(u) / max(1e-4, share**4), str(k), k, len(re.findall(r"[^ \t\n\r]+", text))))
    size = {s: sum(r[3] for r in own) for s, own in sources.items()}
    raw = {s: n**0.75 for s, n in size.items()}
    weight = {s: raw[s] / sum(raw.values()) for s in raw if size[s]}
    total = max(size[s] / w for s, w in weight.items())
    out = {}
    for s, w in weight.items():
        budget = math.floor(total * w + 0.001)
        left = budget % size[s]
        for _, _, k, n in sorted(sources[s]):
            left -= n
            out[k, s] = budget // size[s] + (left >= 0)
    return {k: v for k, v in out.items() if v}


def test_mixing_is_that_of_sorted_sources(docs_of):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(("word", "w0rd", "12", "é!")) for _ in range(rng.randint(0, 30))), rng.choice("aaaab")) for k in range(300)]
    rows += [(400, "tie tie", "c"), (401, "tie tie", "c"), (402, None, "c"), (403, "", None), (404, "one", None)]
    want = brute_mixture(rows)
    docs = odd_names(docs_of(rows))
    assert {(r["doc_id"], r["source"]): r["repeats"] for r in mixing.mixture(docs).collect()} == want
    mixed = mixing.mix(docs)
    got = [(r["doc_id"], r["source"]) for r in mixed.collect()]
    assert mixed.columns == docs.columns and {k: got.count(k) for k in got} == want


# --- 2 decontamination ---------------------------------------------------------------------------------------


def brute_tiles(item, doc, least):
    """Greedy string tiling by trying all places."""
    a, b, tiles = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for j, i in itertools.product(range(len(doc)), range(len(item))):
            n = 0
            while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                n += 1
            best = max(best, (n, -j, -i))
        n, j, i = best[0], -best[1], -best[2]
        if n < least:
            return tiles
        tiles.append((i, j, n))
        a[i : i + n] = [True] * n
        b[j : j + n] = [True] * n


def test_tiles():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item, doc = rng.integers(0, 3, rng.integers(1, 25)).astype(np.uint64), rng.integers(0, 3, rng.integers(1, 40)).astype(np.uint64)
        assert decontaminate.greedy_tiles(item, doc, 3) == brute_tiles(item.tolist(), doc.tolist(), 3)


def test_decontamination(spark, docs_of):
    item = [f"q{k}" for k in range(30)]
    moved = " ".join(item[15:] + ["between"] + item[:15])
    bench = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, None), (9, ""), (None, "tiny item"), (10, "never seen by any of these documents at all")], "item_id bigint, text string")
    docs = docs_of(ODD + [(20, "so " + moved), (21, " ".join(item[:9])), (22, "a Tiny, item.")])
    want = {(20, 7, 1.0), (22, None, 1.0)}
    for limit in (decontaminate.BROADCAST_TOKENS, 0):  # broadcast and shuffled
        got = decontaminate.contaminated(docs, bench, broadcast_tokens=limit).collect()
        assert {(r["doc_id"], r["item_id"], r["coverage"]) for r in got} == want
        kept = decontaminate.remove_contaminated(docs, bench, broadcast_tokens=limit)
        assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 5, 6, 21]
    for limit in (decontaminate.BROADCAST_TOKENS, 0):
        named = odd_names(docs)
        assert decontaminate.contaminated(named, bench, broadcast_tokens=limit).count() == 2
        kept = decontaminate.remove_contaminated(named, bench, broadcast_tokens=limit)
        assert kept.columns == named.columns and kept.count() == 9 and {r["__key"] for r in kept.collect()} == {"own"}
    packed = spark.createDataFrame([(1, "many-words/joined,by.signs" * 100)], "item_id bigint, text string")
    assert not decontaminate._fits(packed, 300) and decontaminate._fits(packed, 500)
    assert decontaminate.contaminated(docs_of([]), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


# --- 3 chat ------------------------------------------------------------------------------------------------


def brute_repair(roles):
    """Least cost over all choices, forwards."""
    best = {"": 0}
    for role in roles:
        after = {}
        for state, cost in best.items():
            for to in chat.ROLES:
                change = 0 if role == to else chat.RELABEL
                if to == state:
                    after[to] = min(after.get(to, 99), cost + change + chat.MERGE)
                for path in ((), *((a,) for a in chat.ROLES), *itertools.product(chat.ROLES, repeat=2), *itertools.product(chat.ROLES, repeat=3)):
                    walk = [state, *path, to]
                    if all(b in chat.NEXT[a] for a, b in itertools.pairwise(walk)):
                        after[to] = min(after.get(to, 99), cost + change + chat.INSERT * len(path))
        best = after
    end = {"assistant": 0, "user": 1, "system": 2, "": 2}
    return min(c + chat.INSERT * end[s] for s, c in best.items()) if roles else 0


def test_repair():
    for n in range(5):
        for roles in itertools.product(("system", "user", "assistant", "tool"), repeat=n):
            cost, turns = chat.repair(roles)
            assert cost == brute_repair(roles), roles
            names = [r for r, _ in turns]
            assert all(b in chat.NEXT[a] for a, b in itertools.pairwise(["", *names])) and (not names or names[-1] == "assistant")
            assert [k for _, src in turns for k in src] == list(range(n))


def test_chat_cases(spark):
    df = spark.createDataFrame(
        [(1, 1, "user", "hi", 0), (1, 2, "USER ", "<|im_end|>", 0), (1, 3, "assistant", None, 0), (2, None, None, None, 0), (None, 1, "assistant", "x", 0)], "conv_id bigint, turn bigint, role string, text string, cost int"
    )
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert got[1]["rendered"] == "<|im_start|>user\nhi\n< |im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n" and got[1]["cost"] == 1
    assert got[2]["roles"][-1] == "assistant" and got[None]["roles"] == ["user", "assistant"]
    assert chat.format_conversations(df.limit(0)).count() == 0
    long = [(1, k, "user", LONG if k == 1 else "x", "y") for k in range(300)] + [(1, 5, "user", "x", "y")] * 2  # repeated rows and tied turns
    out = chat.format_conversations(spark.createDataFrame(long, "conv_id bigint, turn bigint, role string, text string, roles string")).collect()
    assert len(out) == 1 and out[0]["rendered"].count("word") == 60_000


# --- 4 token output ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 7, 15, 17, 32])
def test_packing(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 9, 10, 11, 1000):
        ids = rng.integers(0, 2**width, n, dtype=np.uint64).astype(np.uint32)
        packed, offsets = tokens.pack(ids, width, 10)
        assert len(packed) == offsets[-1] and (tokens.unpack(packed, n, width, 10) == ids).all()
        for a, b in ((0, n), (3, 15), (n - 1, n + 5), (5, 5)):
            assert (tokens.read_range(packed, offsets, n, width, a, b, 10) == ids[max(a, 0) : max(b, 0)]).all()


def test_token_rows(docs_of):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.TOKENIZER)
    rows = ODD + [(10, "Two  spaces, and   three "), (11, " lead ▁ sign"), (12, "naïve 漢字 🙂\nnew\x00line")]
    got = tokens.pack_documents(docs_of(rows)).collect()
    assert len(got) == len(rows)
    want = sorted((str(k), *model.encode(t or "")) for k, t, *_ in rows)
    assert sorted((str(r["doc_id"]), *tokens.unpack(bytes(r["packed"]), r["n_tokens"], r["bit_width"], r["block_size"]).tolist()) for r in got) == want
    assert tokens.pack_documents(docs_of([])).count() == 0 and tokens.bit_width(32000) == 15


# --- 5 quality -------------------------------------------------------------------------------------------------


def test_quality(spark, docs_of):
    rng = random.Random(5)
    good, bad = "river stone garden letter morning window".split(), "buy click cheap offer $$$ now".split()
    rows = [(k, " ".join(rng.choices(good if k % 2 else bad, k=rng.randint(5, 40)))) for k in range(300)]
    docs = docs_of(rows + [(1000, None), (1001, ""), (None, "river garden"), (1002, "river stone " * 50_000)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.score_quality(docs, model).collect()}
    assert len(got) == 304 and model["accuracy"] > 0.95
    assert sum(got[k]["keep"] == bool(k % 2) for k in range(200, 300)) > 95  # rows it wasn't trained on
    assert got[1002]["keep"] and got[1000]["quality"] == got[1001]["quality"]
    assert quality.score_quality(docs, quality.fit(docs, labels.limit(0))).where("not keep").count() == 0
    assert quality.score_quality(docs_of([]), model).count() == 0


def naive_features(text):
    """Counts of each family's n-grams, by words and by characters."""
    w = words_of(text)
    for n in (1, 2):
        yield [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([tuple(w)] if w else [])
    for n in quality.CHARS:
        yield [text[i : i + n] for i in range(len(text) - n + 1)]


def test_quality_features_and_scores():
    texts = ["añb𝄞cd añb", "", "ab", "Hello hello world, héllo", "x" * 3000]
    weights = np.random.default_rng(0).normal(size=1 << quality.BITS).astype(np.float32)
    families = [*quality.features(pa.array(texts))]
    places = [{} for _ in families]  # what place each n-gram has got
    total = [0.0] * len(texts)
    for t, text in enumerate(texts):
        for f, grams in enumerate(naive_features(text)):
            at, first = families[f]
            own = at[first[t] : first[t + 1]].tolist()
            assert len(own) == len(grams)
            assert all(places[f].setdefault(g, p) == p for g, p in zip(grams, own, strict=True))
            total[t] += float(weights[own].mean()) if own else 0.0
    assert quality.raw_scores(pa.array(texts), weights) == pytest.approx(total, abs=1e-5)
    assert sum(len({*p.values()}) > 0.99 * len(p) for p in places) == len(places)


def test_quality_tiers(docs_of):
    model = {"weights": np.zeros(1 << quality.BITS, np.float32), "bias": 0.0, "a": 1.0}
    for b, tier, keep in ((-1.0, "poor", False), (0.0, "fair", True), (3.0, "good", True)):
        rows = quality.score_quality(odd_names(docs_of(ODD)), model | {"b": b}).collect()
        assert len(rows) == len(ODD) and {(r["tier"], r["keep"]) for r in rows} == {(tier, keep)}


# --- 6 n-gram Jaccard --------------------------------------------------------------------------------------------


def brute_pairs(rows, threshold=jaccard.THRESHOLD):
    sets = {}
    for k, text, *_ in rows:
        w = words_of(text)
        if k is not None and w:
            sets.setdefault(k, []).append({*zip(*(w[i:] for i in range(jaccard.N)), strict=False)} if len(w) >= jaccard.N else {tuple(w)})
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if any(len(x & y) >= threshold * len(x | y) for x in sets[a] for y in sets[b])}


def near_rows(seed=2):
    rng = random.Random(seed)
    rows = []
    for group in range(25):
        base = [f"w{rng.randint(0, 500)}" for _ in range(60)]
        for _ in range(rng.randint(1, 6)):
            text = [w if rng.random() > 0.06 else "zz" + str(rng.randint(0, 99)) for w in base]
            rows.append((len(rows) + 100, " ".join(text)))
    return rows + ODD


def brute_classes(rows):
    """class_id and n_links of each doc_id by brute force; a doc_id's texts are counted one by one."""
    texts = {}
    for k, text, *_ in rows:
        if k is not None:
            w = words_of(text)
            texts.setdefault((k, frozenset(zip(*(w[i:] for i in range(jaccard.N)), strict=False) if len(w) >= jaccard.N else ([tuple(w)] if w else []))), k)
    nodes = [*texts]
    links, least = dict.fromkeys(nodes, 0), {n: n[0] for n in nodes}
    pairs = [(a, b) for a, b in itertools.combinations(nodes, 2) if a[1] and b[1] and len(a[1] & b[1]) >= jaccard.THRESHOLD * len(a[1] | b[1])]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in nodes:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return {k: (min(least[n] for n in nodes if n[0] == k), sum(links[n] for n in nodes if n[0] == k)) for k, _ in nodes}


def found_classes(df):
    rows = df.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows}


def test_jaccard_is_exact(docs_of):
    rows = near_rows()
    want = brute_classes(rows)
    docs = docs_of(rows)
    for block, flush in ((jaccard.BLOCK, jaccard.FLUSH), (2, 1)):
        assert found_classes(jaccard.ngram_jaccard_join(docs.repartition(3), block=block, flush_grams=flush)) == want
    assert want[4] == want[5] == (4, 1) and want[2] == (2, 0)


def test_jaccard_over_several_flushes_and_blocks(docs_of):
    rng = random.Random(12)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
    rows = [(k, " ".join(w if rng.random() > 0.03 else f"own{rng.randint(0, 10**6)}" for w in base[: rng.choice((90, 150, 250, 400))])) for k in range(60)]
    rows += [(100 + k, " ".join(f"v{rng.randint(0, 60)}" for _ in range(200))) for k in range(40)]  # few words, so that many n-grams meet by chance
    rows += [(7, "another text under an id that is taken already"), (300, rows[3][1]), (301, rows[3][1])]
    want = brute_classes(rows)
    docs = docs_of(rows).withColumn("gone", F.lit(1)).withColumn("_gone", F.lit(2)).coalesce(1)
    assert found_classes(jaccard.ngram_jaccard_join(docs, block=8, flush_grams=1)) == want
    kept = jaccard.keep_one_of_each_group(docs, block=8)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, (c, _) in want.items() if k == c}
    shuffled = jaccard.keep_one_of_each_group(docs, block=8, broadcast_ids=0)
    assert sorted(shuffled.select("doc_id", "text").collect()) == sorted(kept.select("doc_id", "text").collect())


def test_the_overlaps_of_two_ranges(docs_of):
    """Sets at the threshold and just under it."""
    words = lambda a, b: " ".join(f"t{k}" for k in range(a, b))
    rows = [(1, words(0, 32)), (2, words(10, 42)), (3, words(11, 43)), (4, words(100, 122)), (5, words(100, 112)), (6, words(100, 111))]
    assert found_classes(jaccard.ngram_jaccard_join(docs_of(rows))) == brute_classes(rows)


def test_tree_is_exact():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 40)).astype(np.uint64)) for _ in range(200)]
    size = np.array([len(s) for s in sets])
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))}
    assert {(i, j) for i, near in jaccard.similar_sets(sets, size, None, None, 0.5) for j in near} == want
    left, right = sets[:80], sets[80:]
    assert {(i, j + 80) for i, near in jaccard.similar_sets(left, size[:80], right, size[80:], 0.5) for j in near} == {(i, j) for i, j in want if i < 80 <= j}


def test_bundles():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        x = np.unique(rng.integers(0, 1 << 56, n, dtype=np.uint64))
        assert (jaccard._undo(*jaccard._deltas(x)) == x).all()
        assert [a.tolist() for a in jaccard._open(jaccard._bundle(x, np.array([1, 2], np.uint8)))] == [x.tolist(), [1, 2]]


def test_keep_one(docs_of):
    docs = docs_of([(9, "one two three four five"), (3, "one two three four five"), (3, "one two three four five"), (None, "one two three four five"), (None, None), (8, ""), (12, None)])
    kept = jaccard.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["12", "3", "8", "None", "None"]
    assert jaccard.keep_one_of_each_group(docs_of([])).count() == 0 and jaccard.ngram_jaccard_join(docs_of([])).count() == 0


# --- 7 HTML ------------------------------------------------------------------------------------------------------


_TOKEN = re.compile(r"<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<[^<>]*>|(?:[^\s<]|<(?![^<>]*>))+", re.S | re.I)


def plain_tokens(text):
    """(what tells tokens apart, path, whether it's a word, text, whether it ends words) in order, one token at a time."""
    stack, before, since = [], "", 0
    for m in _TOKEN.finditer(text or ""):
        raw, path = m.group(), "/".join(stack)
        if raw.startswith("<!--"):
            continue
        name = re.match(r"</?\s*([a-zA-Z][\w:-]*)", raw)
        if not (raw[0] == "<" and raw[-1] == ">"):
            yield (path, before, since, raw), path, True, raw, False
            since += 1
            continue
        tag = name[1].lower()
        classes = "" if m[1] else ".".join(sorted({w for c in re.findall(r"(?:class|id)='([^']*)'", raw) for w in c.split()}))
        own = f"{tag}.{classes}" if classes and raw[1] != "/" else tag
        if raw[1] == "/" and tag in markup.BLOCKS:
            at = [k for k, x in enumerate(stack) if x.partition(".")[0] == tag]
            del stack[at[-1] if at else len(stack) :]
            path = "/".join(stack)
        elif raw[1] != "/" and tag in markup.BLOCKS and not raw.endswith("/>") and not m[1]:
            stack.append(own)
        before, since = (raw[1] == "/", tag), 0
        yield (path, raw[1] == "/", own), "/".join(stack), False, raw, tag in markup.BREAKS


def brute_extract(pages):
    """The slots of one host's pages: occurrence vectors, orders and gaps taken from all pages."""
    read = [[*plain_tokens(p)] for p in pages]
    n = len(pages)
    words = {t[0]: t[2] for page in read for t in page}
    vector = {t: tuple(sum(x[0] == t for x in page) for page in read) for t in words}
    need = lambda word: max(2, math.ceil((template.WORD_SUPPORT if word else template.SUPPORT) * n - 1e-9))
    vector = {t: v for t, v in vector.items() if sum(map(bool, v)) >= need(words[t])}
    bones = [[x[0] for x in page if x[0] in vector] for page in read]
    places = {t: [b.index(t) for b in bones if t in b] for t in vector}
    groups = {}
    for t, v in vector.items():
        groups.setdefault((words[t], v), []).append(t)
    classes = []
    for (word, v), own in groups.items():
        orders = [sorted(own, key=lambda t, f=f: f(places[t])) for f in (sum, min, max)]
        kept = [t for t, x, y in zip(*orders, strict=True) if t == x == y]
        if len(own) < template.MIN_TOKENS or (word and kept != own and len(kept) < len(own)) or len(kept) < template.MIN_TOKENS:
            continue
        if all([t for t in b if t in kept] == kept * (b.count(kept[0])) for b in bones):
            classes.append((sum(map(bool, v)), kept))
    classes.sort(key=lambda c: (-c[0], -len(c[1])))

    def gaps(a, b):
        out = set()
        for bone in bones:
            last = -1
            for t in bone:
                if t in a:
                    last = a.index(t)
                elif t in b and a[0] in bone:
                    out.add(last)
        return out

    fits = lambda a, b: len(gaps(a, b)) <= 1 or gaps(a, b) == {-1, len(a) - 1}
    nested = []
    for _, c in classes:
        if all(fits(k, c) or fits(c, k) for k in nested):
            nested.append(c)
    known = {t for c in nested for t in c}
    out = []
    for page in read:
        slots, fresh, last = [], True, None
        for t, path, word, text, ends in page:
            if t in known or not word:
                fresh = fresh or t in known or ends
            else:
                if fresh or path != last:
                    slots.append((path, []))
                slots[-1][1].append(text)
                fresh, last = False, path
        out.append([(path, " ".join(w)) for path, w in slots])
    return len(known), out


def site_pages(seed, n=14):
    """Pages with a frame, two layouts, an optional block and lists of varying length."""
    rng = random.Random(seed)
    some = lambda k: " ".join(f"w{rng.randint(0, 99999)}" for _ in range(k))
    for k in range(n):
        items = "".join(f"<li><a href='/{rng.random()}'>{some(1)}</a></li>" for _ in range(rng.randint(1, 4)))
        aside = f"<aside id='rel'><h2>Read also these</h2><p>{some(2)}</p></aside>" if k % 2 else ""
        body = f"<table><tr><td>Price</td><td>{some(1)}</td></tr></table>" if k % 3 == 0 else f"<article><h1>{some(3)}</h1><p>By the author</p>{some(9)}<p>{some(4)}</article>"
        yield f"<html><head><title>{some(2)}</title><script>x='<p>'</script></head><body><ul>{items}</ul><!-- no -->{body}{aside}<div class='f z'>All rights reserved <b>{some(1)}</b></div></body></html>"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id bigint, url string, html string, h int, mark int")


def test_templates_are_those_of_brute_force(spark):
    sites = {f"site{k}.org": [*site_pages(k)] for k in range(3)} | {"two.org": [*site_pages(9, 2)]}
    sites["twice.org"] = sites["site0.org"] * 2  # every page twice, with other urls
    rows = [(len(site) * 1000 + k, f"http://{site}/{k}", p) for site, own in sites.items() for k, p in enumerate(own)]
    rows += [(1, "http://same.org/", sites["site1.org"][k % 5]) for k in range(10)]  # rows repeated exactly
    sites["same.org"] = [sites["site1.org"][k % 5] for k in range(10)]
    want = {site: brute_extract(own) for site, own in sites.items()}
    for broadcast in (template.BROADCAST_TOKENS, 0):
        got = {}
        for r in template.extract_pages(pages_of(spark, rows).repartition(3), broadcast_tokens=broadcast).collect():
            got.setdefault(r["host"], []).append(r)
        for site, (size, slots) in want.items():
            assert {r["template_size"] for r in got[site]} == {size} and size > 5, site
            assert sorted([(s["path"], s["text"]) for s in r["slots"]] for r in got[site]) == sorted(slots), site
    everything = " ".join(s["text"] for r in got["site0.org"] for s in r["slots"])
    assert not any(w in everything for w in ("rights", "reserved", "author", "also"))  # the optional block's and a layout's too


def test_slots_have_class_and_gap(spark):
    rows = [(k, f"http://a.org/{k}", f"<html><body><ul>{''.join(f'<li>item{k}x{j}</li>' for j in range(1 + k % 3))}</ul><p>text{k}</p></body></html>") for k in range(6)]
    for r in template.extract_pages(pages_of(spark, rows)).collect():
        places = {s["text"]: (s["class"], s["gap"]) for s in r["slots"]}
        own = {v for t, v in places.items() if t.startswith("item")}
        assert len(own) == 1 and len({places[f"text{r['page_id']}"]} | own) == 2 and (-1, -1) not in places.values()


def test_crossing_classes_dont_nest():
    size, on = {0: 3, 1: 3, 2: 3}, {0: 9, 1: 8, 2: 7}
    valid = {(c, c): (1, 1) for c in size}
    assert set(template.nest(size, on, valid | {(0, 1): (0, 0), (1, 0): (-1, 2), (0, 2): (0, 1), (2, 0): (0, 1), (1, 2): (0, 0), (2, 1): (-1, 2)})) == {0, 1}
    assert template.nest(size, on, valid | {(0, 1): (0, 0), (1, 2): (1, 1), (0, 2): (0, 0), (1, 0): (-1, 2), (2, 0): (-1, 2), (2, 1): (-1, 2)})[2] == [(0, 0), (1, 1)]
    assert set(template.nest(size, on, valid | {(1, 1): (0, 0)})) == {0, 2}


def test_template_cases(spark):
    body = lambda k: f"<html><head><title>Site</title></head><body><nav><a>Home page</a></nav><div class='main'><h1>Title{k}</h1><p>Story number{k} tells of{k * 7} things</p></div><footer>All rights reserved here</footer></body></html>"
    rows = [(k, f"http://Example.org:80/{k}", body(k)) for k in range(8)] + [(50, None, None), (51, "http://lone.org/", "<p>Lone &amp; text"), (None, "//example.org/x", body(9))]
    rows += [(60, "http://long.org/", "<p>" + "word " * 200_000), (61, "http://deep.org/", "<div>" * 3000 + "deep"), (62, "http://odd.org/", "a < b > c <1> <!-- open <p"), (63, "http://lone.org/", "")]
    got = {r["page_id"]: r for r in template.extract_pages(pages_of(spark, rows)).collect()}
    assert len(got) == 15 and got[3]["host"] == "example.org" and got[3]["template_size"] > 5
    assert "number3" in got[3]["text"] and "Title3" in got[3]["text"] and "reserved" not in got[3]["text"] and "Home" not in got[3]["text"]
    assert got[50]["slots"] == [] and got[51]["text"] == "Lone & text" and "number9" in got[None]["text"]
    assert len(got[60]["text"]) == 999_999 and got[61]["text"] == "deep" and "a" in got[62]["text"]
    assert template.extract_pages(pages_of(spark, []), broadcast_tokens=0).count() == 0


# --- 8 toxicity -----------------------------------------------------------------------------------------------------


def brute_score(classes):
    """All paths of the composed machine, enumerated."""
    machine = toxicity.Grammar().machine
    paths = [(machine.start, 0.0)]
    for symbol in classes:
        paths = [(to, w + weight) for state, w in paths for _, to, weight in machine.arcs[state].get(symbol, ())]
    return max((w for s, w in paths if "want" not in s.split(",")), default=0.0)


def test_grammar():
    grammar = toxicity.Grammar()
    for n in range(5):
        for classes in itertools.product("IVTNRFO", repeat=n):
            assert grammar.score("".join(classes)) == pytest.approx(brute_score(classes))


def paths(part, symbols):
    """(output, weight, last state) of all paths of one transducer."""
    found = [("", 0.0, part.start)]
    for symbol in symbols:
        found = [(out + o, w + weight, to) for out, w, state in found for o, to, weight in part.step(state, symbol)]
    return found


def test_the_composed_machine_is_one_transducer_after_another():
    grammar = toxicity.Grammar()
    parts = [toxicity.reported(), toxicity.negation(), toxicity.target(), toxicity.threat(), toxicity.insult()]
    rng = random.Random(7)
    cases = ["".join(c) for n in range(4) for c in itertools.product(toxicity.INPUT, repeat=n)] + ["".join(rng.choices(toxicity.INPUT, k=rng.randint(4, 9))) for _ in range(1500)]
    for classes in cases:
        strings = {classes: 0.0}
        for part in parts:
            after = {}
            for text, so_far in strings.items():
                for out, weight, state in paths(part, text):
                    if state != "want":
                        after[out] = max(after.get(out, -1.0), so_far + weight)
            strings = after
        assert grammar.score(classes) == pytest.approx(max(strings.values(), default=0.0)), classes


def test_toxicity_of_repeated_and_tied_rows(docs_of):
    rows = [(1, "You are a total idiot."), (1, "You are a total idiot."), (2, "You are a total idiot. You are a total idiot."), (3, LONG + "You are a total idiot."), (None, "You are a total idiot.")]
    docs = odd_names(docs_of(rows + ODD))
    got = toxicity.toxic_documents(docs, None).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "2", "3", "None"] and len({r["toxicity"] for r in got}) == 1  # the highest clause counts
    kept = toxicity.remove_toxic(docs, None)
    assert kept.columns == docs.columns and kept.count() == len(ODD)


def test_toxicity(docs_of):
    cases = {"You are a total idiot.": True, "You are not an idiot.": False, "They said he is an idiot": False, "I will kill you": True, "I will not kill you": False, "kill the process": False, "A quiet morning": False}
    docs = docs_of([*enumerate(cases, 100), *ODD])
    assert {r["doc_id"] for r in toxicity.toxic_documents(docs, None).collect()} == {k for k, v in enumerate(cases.values(), 100) if v}
    kept = toxicity.remove_toxic(docs, None)
    assert kept.columns == docs.columns and kept.count() == len(ODD) + list(cases.values()).count(False)
    assert toxicity.toxic_documents(docs_of([]), None).count() == 0


def test_a_bare_insult_needs_context(docs_of):
    clean = ["The trash is full.", "a clown fish", "vermin control", "a stupid bug", "They said he is an idiot. They said he is a moron.", "The trash is full. " + "Other words. " * 100 + "A clown fish."]
    toxic = ["What a stupid idiot", "This is trash. Only a clown would read it.", "Trash. All trash. Such trash.", "You clown"]
    assert {r["doc_id"] for r in toxicity.toxic_documents(docs_of([*enumerate(clean), *enumerate(toxic, 100)]), None).collect()} == {100, 101, 102, 103}


def test_learned_stems(spark, docs_of):
    rng = random.Random(8)
    plain = [f"plain{k}" for k in range(80)]
    rows = [(k, " ".join(rng.sample(plain, 12)) + (". you grubnik here" if k % 4 == 0 else ".")) for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(100)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    found = {r["doc_id"] for r in toxicity.toxic_documents(docs_of(rows), labels).collect()}
    assert found == {k for k in range(200) if k % 4 == 0}


def test_every_toxic_word_is_learned(docs_of, spark):
    rng = random.Random(9)
    plain = [f"plain{k}" for k in range(80)]
    bad = {k: ["grubnik"] + ["zorvath"] * (k % 8 == 0) for k in range(0, 200, 4)}  # whatever has the second word has the first
    docs = docs_of([(k, " ".join(rng.sample(plain, 12) + bad.get(k, []))) for k in range(200)])
    labels = spark.createDataFrame([(k, int(k in bad)) for k in range(200)], "doc_id bigint, toxic int")
    assert toxicity.learn_stems(docs, labels)["en"] == ["grubnik$", "zorvath$"]
    assert {(r["toxic"], r["rows"] > 20, r["found"] > 0) for r in toxicity.held_out(docs, labels, 0.5).collect()} == {(0, True, False), (1, True, True)}


def test_only_copies_count_once(docs_of, spark):
    rng = random.Random(10)
    words = [f"vocabulary{k}" for k in range(400)]
    text = {k: ["vocabulary0shared", *rng.sample(words, 30)] for k in range(40)}  # many share their lowest hash of long words
    text |= {100 + k: [*text[k][:-1], "changed"] for k in range(5)} | {200: text[7]}
    labels = spark.createDataFrame([(k, 0) for k in text], "doc_id bigint, toxic int")
    keys = {r["doc_id"]: r["key"] for r in toxicity.labelled_rows(docs_of([(k, " ".join(w)) for k, w in text.items()]), labels).collect()}
    assert len(keys) == 46 and len(set(keys.values())) == 40
    assert keys[200] == keys[7] and all(keys[100 + k] == keys[k] for k in range(5))


def test_support_suits_the_language():
    assert toxicity.least_support([(1, 500, 50), (2, 80, 10), (3, 60, 20)], 0.02, 5, 0.97) == 2
    assert toxicity.least_support([(2, 4000, 60), (3, 3000, 4), (4, 9000, 2), (6, 10, 2)], 0.1, 5, 0.97) == 5


# --- 9 lattice ---------------------------------------------------------------------------------------------------------


def test_lattice_is_the_sum_over_segmentations():
    pieces = {"▁": -2.0, "a": -1.0, "b": -1.5, "ab": -0.7, "▁a": -0.9, "ba": -2.2}
    lat = lattice.Lattice(pieces, np.full(256, -8.0))

    def brute(text):
        if not text:
            return 1.0
        return sum(math.exp(s) * brute(text[len(p) :]) for p, s in pieces.items() if text.startswith(p)) + (math.exp(-8.0 * len(text[0].encode())) * brute(text[1:]) if text[0] not in pieces else 0)

    words = ["a", "ab", "abab", "bbb", "xab", "é", "abaab"]
    assert lat.log_prob(words) == pytest.approx([math.log(brute("▁" + w)) for w in words])


def test_lm_scores(docs_of):
    got = {}
    for r in lattice.lm_scores(docs_of(ODD)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[2][0]["log_prob"] == 0 and got[2][0]["bits_per_char"] is None and got[1][0]["n_words"] == 0 and got[3][0]["n_words"] == 60_000
    assert len(got[4]) == 2 and got[4][0] == got[4][1] and got[5][0]["log_prob"] == got[4][0]["log_prob"] < 0
    assert lattice.lm_scores(docs_of([])).count() == 0


# --- 10 sharding --------------------------------------------------------------------------------------------------------


def test_fisher_yates():
    counts = {}
    for seed in range(3000):
        key = tuple(sharding.fisher_yates(3, seed).tolist())
        counts[key] = counts.get(key, 0) + 1
    assert len(counts) == 6 and min(counts.values()) > 400


def naive_shuffle(n, seed):
    draws, out = np.random.default_rng(seed).random(max(n - 1, 0)), [*range(n)]
    for i, u in zip(range(n - 1, 0, -1), draws, strict=True):
        j = int(u * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def test_shards_are_shuffled_buckets(docs_of, tmp_path, spark):
    docs = docs_of([(k, f"text {k % 40}") for k in range(200)] + ODD)
    hashed = docs.select("doc_id", "text", F.xxhash64(F.lit(sharding.SEED), *docs.columns).alias("h"))
    rows = [tuple(r) for r in hashed.withColumn("shard", F.pmod(F.xxhash64("h", F.lit(sharding.SEED + 1)), F.lit(7))).collect()]
    want = {}
    for shard in range(7):
        own = sorted((r for r in rows if r[3] == shard), key=lambda r: (r[2], r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        want |= {(shard, place): own[at][:2] for place, at in enumerate(naive_shuffle(len(own), sharding.SEED * 1_000_003 + shard))}
    for partitions in (20_000, 3):  # one bucket a partition, and several
        got = sharding.shuffle_into_shards(docs, n_shards=7, max_partitions=partitions).collect()
        assert {(r["shard"], r["position"]): (r["doc_id"], r["text"]) for r in got} == want
    sharding.write_shards(docs, f"{tmp_path}/shards", n_shards=7)
    back = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert {(r["shard"], r["position"]): (r["doc_id"], r["text"]) for r in back} == want
    assert len([*(tmp_path / "shards").glob("*.parquet")]) == 7


def test_shards_of_odd_tables(docs_of):
    docs = odd_names(docs_of(ODD)).withColumn("hash", F.lit("h")).withColumn("Position", F.lit("clash"))
    out = sharding.shuffle_into_shards(docs, n_shards=3)
    assert out.columns == [*[c for c in docs.columns if c != "Position"], "shard", "position"] and out.count() == len(ODD) and {r["map"]["k"] for r in out.collect()} == {1}
    assert sharding.shuffle_into_shards(docs.drop("doc_id", "text")).count() == len(ODD)


def test_shards(docs_of):
    docs = docs_of(ODD + [(k, f"text {k}") for k in range(100, 200)]).withColumn("shard", F.lit("clash"))
    out = sharding.shuffle_into_shards(docs, n_shards=4)
    got = out.collect()
    key = lambda rows: sorted(str((r["doc_id"], r["text"])) for r in rows)
    assert key(got) == key(docs.collect())
    for shard in range(4):
        own = [r["position"] for r in got if r["shard"] == shard]
        assert sorted(own) == list(range(len(own))) and 10 < len(own) < 50
    again = {(r["shard"], r["position"]): r["doc_id"] for r in sharding.shuffle_into_shards(docs.repartition(3), n_shards=4).collect()}
    assert again == {(r["shard"], r["position"]): r["doc_id"] for r in got}
    assert sharding.shuffle_into_shards(docs_of([])).count() == 0
