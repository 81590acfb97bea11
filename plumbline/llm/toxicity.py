"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as a string of word classes. Five transducers, each with weights on its arcs, are
composed into one machine: reported speech marks what follows a verb of saying, negation marks an insult
within reach of a negator, target marks an insult or threat aimed at a person, threat recognises intent +
harm, insult turns marked symbols into weights. A clause scores the weight of the machine's best path, and a
document is toxic if its highest clause or passage reaches a fixed threshold. No seed word scores enough by itself: a bare
insult ("the trash is full") takes a target, another insult in its clause, or more insults within the same passage (two
different words, or one three times); "not an idiot" and "they said he is an idiot" count for no passage.
A learned word that is no seed does decide by itself where it is neither quoted nor negated: the labels show just that
of it, and planted documents carry bare insults of which only some are learned.

The insult classes are seed words plus every word and word stem that labelled rows show to be toxic (stems_of).

Nulls: a null text is the empty text, which isn't toxic; a null doc_id stays null; a null language is its own language. Repeated rows are scored one by one. Of paths of equal weight any may be the best, as only the weight counts; a score equal to the threshold
is toxic. Texts of any length are scored whole. An empty table gives no rows. Other columns may have any names.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.support import cut, map_rows, normal_text, releasing, small_batches

# --- transducers ---------------------------------------------------------------------------------

#: Input symbols: I insult, L learned insult, V harm verb, T target, N negator, R verb of saying, F intent, C filler (copula, article, degree), O other.
INPUT = "ILVTNRFCO"


class Transducer:
    """Arcs: state -> symbol -> [(output symbol, next state, weight)]; a symbol without arcs in a state follows '*'."""

    def __init__(self, arcs: dict[str, dict[str, list[tuple[str, str, float]]]], start: str = "0") -> None:
        self.arcs, self.start = arcs, start

    def step(self, state: str, symbol: str) -> list[tuple[str, str, float]]:
        own = self.arcs[state]
        return [(symbol if out == "=" else out, to, weight) for out, to, weight in own.get(symbol, own.get("*", []))]


def compose(first: Transducer, second: Transducer, symbols: Iterable[str]) -> Transducer:
    """The transducer that feeds the output of ``first`` to ``second``; weights add. Only states that can be reached are built."""
    start, arcs = f"{first.start},{second.start}", {}
    todo = [(first.start, second.start)]
    while todo:
        a, b = todo.pop()
        if (here := f"{a},{b}") in arcs:
            continue
        arcs[here] = defaultdict(list)
        for symbol in symbols:
            for middle, a2, w1 in first.step(a, symbol):
                for out, b2, w2 in second.step(b, middle):
                    arcs[here][symbol].append((out, f"{a2},{b2}", w1 + w2))
                    todo.append((a2, b2))
    return Transducer({k: dict(v) for k, v in arcs.items()}, start)


def reported() -> Transducer:
    """After a verb of saying, insults and harm verbs are quoted: I, L -> i, V -> v."""
    return Transducer({
        "0": {"R": [("=", "1", 0.0)], "*": [("=", "0", 0.0)]},
        "1": {"I": [("i", "1", 0.0)], "L": [("i", "1", 0.0)], "V": [("v", "1", 0.0)], "*": [("=", "1", 0.0)]},
    })


def negation() -> Transducer:
    """A negator with at most two fillers before an insult, intent or harm verb cancels it: I, L, i -> n; F, V, v -> O."""
    cancel = {"I": [("n", "0", 0.0)], "L": [("n", "0", 0.0)], "i": [("n", "0", 0.0)], "V": [("O", "0", 0.0)], "v": [("O", "0", 0.0)], "F": [("O", "0", 0.0)]}
    return Transducer({
        "0": {"N": [("=", "1", 0.0)], "*": [("=", "0", 0.0)]},
        "1": cancel | {"N": [("=", "1", 0.0)], "C": [("=", "2", 0.0)], "T": [("=", "2", 0.0)], "*": [("=", "0", 0.0)]},
        "2": cancel | {"N": [("=", "1", 0.0)], "C": [("=", "3", 0.0)], "T": [("=", "3", 0.0)], "*": [("=", "0", 0.0)]},
        "3": cancel | {"N": [("=", "1", 0.0)], "*": [("=", "0", 0.0)]},
    })


def target() -> Transducer:
    """A target with at most three fillers before ("you are a total idiot") or right after an insult strengthens it: I, L -> A."""
    aim = [("A", "0", 0.0)]
    return Transducer({
        "0": {"T": [("=", "1", 0.0)], "I": [("=", "0", 0.0), ("A", "want", 0.0)], "L": [("=", "0", 0.0), ("A", "want", 0.0)], "*": [("=", "0", 0.0)]},
        "1": {"I": aim, "L": aim, "T": [("=", "1", 0.0)], "C": [("=", "2", 0.0)], "*": [("=", "0", 0.0)]},
        "2": {"I": aim, "L": aim, "T": [("=", "1", 0.0)], "C": [("=", "3", 0.0)], "*": [("=", "0", 0.0)]},
        "3": {"I": aim, "L": aim, "T": [("=", "1", 0.0)], "C": [("=", "4", 0.0)], "*": [("=", "0", 0.0)]},
        "4": {"I": aim, "L": aim, "T": [("=", "1", 0.0)], "*": [("=", "0", 0.0)]},
        "want": {"T": [("=", "1", 0.0)]},
    })


def threat() -> Transducer:
    """Intent, at most two others, a harm verb, at most one other, then a target is a threat: the target becomes K (k if quoted)."""
    arcs: dict = {"0": {"F": [("=", "1", 0.0)], "*": [("=", "0", 0.0)]}}
    for state, after in (("1", "2"), ("2", "3"), ("3", "0")):
        arcs[state] = {"V": [("=", "h", 0.0)], "v": [("=", "q", 0.0)], "F": [("=", "1", 0.0)], "*": [("=", after, 0.0)]}
    for state, after, out in (("h", "g", "K"), ("g", "0", "K"), ("q", "p", "k"), ("p", "0", "k")):
        arcs[state] = {"T": [(out, "0", 0.0)], "F": [("=", "1", 0.0)], "*": [("=", after, 0.0)]}
    return Transducer(arcs)


#: Weights of the marked symbols: insult, learned insult, aimed insult, quoted, negated, threat, quoted threat.
WEIGHTS = {"I": 0.6, "L": 1.0, "A": 1.5, "i": 0.4, "n": 0.1, "K": 2.0, "k": 0.6}


def insult(weights: dict[str, float] = WEIGHTS) -> Transducer:
    return Transducer({"0": {s: [(s, "0", w)] for s, w in weights.items()} | {"*": [("=", "0", 0.0)]}})


class Grammar:
    """The composition, as tables of best weights."""

    def __init__(self) -> None:
        machine = reported()
        for part in (negation(), target(), threat(), insult()):
            machine = compose(machine, part, INPUT)
        self.machine, self.known = machine, {}

    def score(self, classes: str) -> float:
        """Weight of the best path over a clause's classes; paths that end while an aimed insult still wants its target are dead."""
        return self.read(classes)[0]

    def read(self, classes: str) -> tuple[float, str]:
        """Weight of the best path and the symbols it marks the clause with, one a word."""
        if classes in self.known:
            return self.known[classes]
        best, back = {self.machine.start: 0.0}, []
        for symbol in classes:
            after: dict[str, float] = {}
            came: dict[str, tuple[str, str]] = {}
            for state, so_far in best.items():
                for out, to, weight in self.machine.arcs[state].get(symbol, ()):
                    if so_far + weight > after.get(to, -1.0):
                        after[to], came[to] = so_far + weight, (state, out)
            best = after
            back.append(came)
        weight, state = max(((v, s) for s, v in best.items() if "want" not in s.split(",")), default=(0.0, ""))
        marks = []
        for came in reversed(back if state else []):
            state, out = came[state]
            marks.append(out)
        value = weight, "".join(reversed(marks))
        if len(self.known) < 100_000:
            self.known[classes] = value
        return value


# --- word classes ----------------------------------------------------------------------------------

#: Seed insults, matched as whole words or, with a trailing '-', as stems.
SEEDS = {
    "": "idiot idiots moron moron- loser losers scum stupid pathetic worthless trash clown clowns disgusting imbecile- scumbag- "
    "dumbass- asshole- bastard- bitch bitches retard- dipshit- fuckwit- jackass- vermin idiota- imbécil- imbecil- estúpid- gilipollas "
    "cabrón- pendej- connard- connasse- salaud- salope- abruti- crétin- débile dummkopf- arschloch- trottel- vollidiot- schwachkopf- missgeburt- wichser-"
}
HARM = "kill murder hurt stab shoot beat destroy strangle burn attack töten umbringen erschießen schlagen verletzen tuer frapper matar golpear destruir apuñalar"
INTENT = "will gonna shall i'll we'll going should must deserve hope werde werden wird soll vais va allons vont voy vamos va quiero"
TARGET = "you your you're u he she they him her them these those du dich ihr euch dir sie ihn tu toi vous ton votre te lui eux ils elle tú usted ustedes ti él ella ellos"
NEGATOR = "not no never isn't aren't wasn't don't doesn't didn't nicht kein keine keinen nie niemals ne pas jamais nunca tampoco"
SAYING = "said says say claimed claims told tells wrote writes called quoted quote reported reports allegedly sagte sagt behauptete schrieb dit disait affirme écrit dijo dice afirmó escribió"
FILLER = "a an the is are was were am be been being so very such really just total complete 're ein eine einen der die das ist bist sind war sehr so un une le la les est es sont était très si una el los las eres son muy tan"

_CLASSES = {w: c for c, many in (("C", FILLER), ("R", SAYING), ("N", NEGATOR), ("T", TARGET), ("F", INTENT), ("V", HARM)) for w in many.split()}
_CLAUSE = re.compile(r"[.!?;:,\n\r|]+|\b(?:but|because|aber|weil|mais|pero|porque)\b")
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?")


#: Characters that a passage may span, and what an insult adds to it that the passage has already.
PASSAGE, AGAIN = 1200, 0.2


def passage(insults: list[tuple[int, str]]) -> float:
    """The highest weight of a passage, from (place, word) of the insults that are neither quoted nor negated: a bare insult's for each word, and AGAIN for each repetition."""
    most, low, seen = 0.0, 0, Counter()
    for at, word in insults:
        seen[word] += 1
        while insults[low][0] < at - PASSAGE:
            seen[insults[low][1]] -= 1
            low += 1
        words = sum(k > 0 for k in seen.values())
        most = max(most, WEIGHTS["I"] * words + AGAIN * (at_hand - words) if (at_hand := seen.total()) else 0.0)
    return round(most, 9)


class Scorer:
    """Scores texts by the grammar over the seed words and the learned stems (by language)."""

    def __init__(self, stems: dict[str, list[str]] | None = None) -> None:
        self.grammar, self.by_lang = Grammar(), {}
        self.stems = stems or {}

    def of(self, lang: str | None) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
        """Patterns of the seed insults, of all insults, and of what a clause must hold to score."""
        if lang not in self.by_lang:
            seeds = SEEDS[""].split()
            insults = self._pattern(seeds + [f"{s}-" if not s.endswith("$") else s[:-1] for s in self.stems.get(lang or "", [])])
            harm = "|".join(sorted(map(re.escape, HARM.split())))
            self.by_lang[lang] = tuple(re.compile(f"(?<![^\\W_])(?:{p})") for p in (self._pattern(seeds), insults, f"{insults}|(?:{harm})(?![^\\W_])"))
        return self.by_lang[lang]

    @staticmethod
    def _pattern(own: list[str]) -> str:
        stems, whole = sorted({w[:-1] for w in own if w.endswith("-")}), sorted({w for w in own if not w.endswith("-")})
        return "|".join([*(re.escape(w) + r"(?![^\W_])" for w in whole), *map(re.escape, stems)])

    def classes(self, clause: str, seeds: re.Pattern, insults: re.Pattern) -> str:
        return "".join("I" if seeds.match(w) else "L" if insults.match(w) else _CLASSES.get(w, "O") for w in _TOKEN.findall(clause))

    def score(self, text: str, lang: str | None) -> tuple[float, float, int]:
        """Highest score of a clause or passage, the sum of the clauses', and the number of clauses that score at all."""
        text = text.lower()
        seeds, insults, triggers = self.of(lang)
        bare: list[tuple[int, str]] = []
        best = total = 0.0
        n, done = 0, -1
        for hit in triggers.finditer(text):
            if hit.start() < done:
                continue
            left = text.rfind("\n", 0, hit.start()) + 1
            for m in _CLAUSE.finditer(text, left, hit.start()):
                left = m.end()
            m = _CLAUSE.search(text, hit.end())
            done = m.start() if m else len(text)
            value, marks = self.grammar.read(self.classes(text[left:done], seeds, insults))
            if value > 0:
                best, total, n = max(best, value), total + value, n + 1
            if any(mark in marks for mark in "ILA"):
                bare += [(left + w.start(), w.group()) for w, mark in zip(_TOKEN.finditer(text, left, done), marks, strict=True) if mark in "ILA"]
        return max(best, passage(bare)) if len(bare) > 1 else best, total, n


# --- stems from labelled rows ------------------------------------------------------------------------


def copy_keys(rows: pd.DataFrame, similarity: float = 0.7, bands: int = 32) -> np.ndarray:
    """The place of the row each row is a copy of, or its own. ``rows``: lang, toxic, n (distinct words) and least, ``4 * bands`` minimum hashes of the words.

    The rows of a language and verdict that share four minimum hashes in a row are compared, and the one with fewer words is a copy if the estimate from all hashes, the share that agree, is at least
    ``similarity``. Copies are compared with rows that are no copies themselves, so that no chain of them links unlike rows.
    """
    key, least = np.arange(len(rows)), np.stack(rows["least"].to_numpy()) if len(rows) else np.zeros((0, 4 * bands), np.int32)
    for _, part in rows.groupby(["lang", "toxic"]):
        kept: dict[tuple[int, bytes], list[int]] = defaultdict(list)
        for at in part.sort_values("n", ascending=False, kind="stable").index:
            places = [(k, least[at, 4 * k : 4 * k + 4].tobytes()) for k in range(bands)]
            near = sorted({other for place in places for other in kept.get(place, ())})
            like = (least[near] == least[at]).mean(axis=1) if near else np.zeros(0)
            if len(like) and like.max() >= similarity:
                key[at] = near[int(like.argmax())]
            else:
                for place in places:
                    kept[place].append(at)
    return key


def labelled_rows(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, seed: int = 42) -> DataFrame:
    """(doc_id, text, lang, toxic, ws, key) of at most ``max_rows`` labelled documents, those of the lowest hash of doc_id; ws are the distinct words. Rows with one key are copies (copy_keys) and count as one that has the words of all."""
    sample = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = cut(
        docs.select("doc_id", normal_text().alias("text"), lang.alias("lang"))
        .join(F.broadcast(sample), "doc_id")  # at most max_rows ids
        .withColumn("ws", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)))
        .withColumn("row", F.xxhash64("doc_id", "text"))
    )
    factor, mask = np.random.default_rng(seed).integers(0, 2**32, (2, 128), dtype=np.uint32)

    def minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.array([xxhash.xxh32_intdigest(w) for w in ws or ("",)], np.uint32) for ws in batch.column("ws").to_pylist()]
            least = [((h[:, None] ^ mask) * (factor | np.uint32(1))).min(axis=0).view(np.int32) for h in words]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "lang", "toxic")), pa.array([len(h) for h in words], pa.int32()), pa.array(least, pa.list_(pa.int32()))], names=["row", "lang", "toxic", "n", "least"]
            )

    found = rows.select("row", "lang", F.col("toxic").cast("int").alias("toxic"), "ws").mapInArrow(minima, "row bigint, lang string, toxic int, n int, least array<int>")
    found = found.toArrow().to_pandas().drop_duplicates("row").sort_values("row", ignore_index=True)  # 128 hashes of each of at most max_rows rows
    keys = docs.sparkSession.createDataFrame(pa.table({"row": pa.array(found["row"], pa.int64()), "key": pa.array(found["row"].to_numpy()[copy_keys(found)], pa.int64())}))
    return rows.join(F.broadcast(keys), "row").drop("row")


def by_chance(n: int, p: float, precision: float) -> float:
    """Probability that a word in n documents, of which each is toxic with probability p, passes the precision test."""
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(math.ceil(precision * n - 1e-9), n + 1)) if n < 200 else 0.0


def least_support(counts: list[tuple[int, int, int]], p: float, least_docs: int, precision: float) -> int:
    """Documents a word must be in, at most ``least_docs``: the fewest (two at least) at which chance accounts for at most 1 - precision of the words that pass.

    ``counts`` holds (n, words in n documents, those that pass the precision test) of a language, p its share of toxic documents.
    """
    for least in range(2, least_docs):
        rows = [(n, words, passed) for n, words, passed in counts if n >= least]
        if sum(words * by_chance(n, p, precision) for n, words, _ in rows) <= (1 - precision) * sum(passed for *_, passed in rows):
            return least
    return least_docs


def stems_of(rows: DataFrame, least_docs: int = 5, precision: float = 0.97, lengths: tuple[int, int] = (4, 8)) -> dict[str, list[str]]:
    """Every word (marked '$') and word stem by language that labelled rows show to be toxic.

    A word is kept if at least ``precision`` of the documents that have it are toxic, and they are as many as least_support() asks for in its language. A stem stands for forms that the labels
    lack, so it is kept if all its words taken together pass the same precision, in ``least_docs`` documents, and they are two words at least; of stems of the same words the longest is.
    """
    word = cut(rows.select("lang", "key", "toxic", F.explode("ws").alias("w")).where(F.length("w") >= lengths[0]).distinct())
    share = {lang: bad / n for lang, bad, n in rows.select("lang", "key", "toxic").distinct().groupBy("lang").agg(F.sum("toxic"), F.count("*")).collect()}
    by_word = cut(word.groupBy("lang", "w").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")))
    passes = F.col("bad") >= precision * F.col("n")
    counts: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
    for lang, n, words, passed in by_word.groupBy("lang", "n").agg(F.count("*"), F.count_if(passes)).collect():
        counts[lang].append((n, words, passed))
    least = {lang: least_support(own, share[lang], least_docs, precision) for lang, own in counts.items()}
    enough = F.lit(False)
    for lang, n in least.items():
        enough = enough | (F.col("lang") == lang) & (F.col("bad") >= n)
    chosen: dict[str, list[str]] = defaultdict(list)
    for lang, w in by_word.where(passes & enough).select("lang", "w").collect():  # the learned words, bounded by max_rows
        chosen[lang].append(f"{w}$")
    stems = F.transform(F.sequence(F.lit(lengths[0]), F.least(F.length("w"), F.lit(lengths[1]))), lambda k: F.col("w").substr(F.lit(1), k))
    good = (
        by_word.select("lang", F.explode(stems).alias("stem"), "bad", "n")
        .groupBy("lang", "stem").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.count("*").alias("words"))
        .where((F.col("bad") >= least_docs) & passes & (F.col("words") > 1))
    )
    held = (
        word.where("toxic = 1").select("lang", "key", "w", F.explode(stems).alias("stem"))
        .join(good.select("lang", "stem"), ["lang", "stem"])
        .groupBy("lang", "stem").agg(F.count_distinct("key").alias("docs"), F.array_sort(F.collect_set("w")).alias("ws"))
        .where(F.col("docs") >= least_docs)
        .groupBy("lang", "ws").agg(F.max_by("stem", F.length("stem")).alias("stem"))
        .select("lang", "stem").collect()  # bounded by max_rows
    )
    for lang, stem in held:
        chosen[lang].append(stem)
    return {lang: sorted(own) for lang, own in chosen.items()}


def learn_stems(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, least_docs: int = 5, precision: float = 0.97, lengths: tuple[int, int] = (4, 8)) -> dict[str, list[str]]:
    """stems_of() the labelled rows. ``max_rows`` bounds the fit; it is the only bound and scoring has none."""
    return stems_of(labelled_rows(docs, labels, max_rows), least_docs, precision, lengths)


def held_out(docs: DataFrame, labels: DataFrame, threshold: float | None = None, max_rows: int = 20_000) -> DataFrame:
    """(lang, toxic, rows, found): labelled rows that reach ``threshold`` with stems learned from the other half of the keys, so that no copy of a row teaches its own verdict."""
    rows = cut(labelled_rows(docs, labels, max_rows))
    half, parts = F.pmod(F.xxhash64("key"), F.lit(2)), []
    for k in (0, 1):
        test = rows.where(half == k)
        scored = score_documents(test.drop("toxic"), stems_of(rows.where(half != k)))
        parts.append(test.select("doc_id", "lang", "toxic").join(scored, "doc_id"))
    found = F.count_if(F.col("toxicity") >= (THRESHOLD if threshold is None else threshold))
    return parts[0].unionByName(parts[1]).groupBy("lang", "toxic").agg(F.count("*").alias("rows"), found.alias("found"))


THRESHOLD = 1.0
SCORES = "doc_id bigint, toxicity double, total_weight double, n_clauses int"


def score_documents(docs: DataFrame, stems: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, toxicity, total_weight, n_clauses) for every row of docs; whole texts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(stems)
        for batch in batches:
            found = [scorer.score(t, lang) for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True)]
            a, b, n = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.float64()), pa.array(b, pa.float64()), pa.array(n, pa.int32())], names=["doc_id", "toxicity", "total_weight", "n_clauses"])

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    return small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), normal_text().alias("text"), lang.alias("lang")).mapInArrow(releasing(run), SCORES)


def toxic_documents(docs: DataFrame, labels: DataFrame | None, threshold: float = THRESHOLD, max_rows: int = 20_000) -> DataFrame:
    """The rows of score_documents that reach ``threshold``, with stems learned from ``labels``."""
    stems = learn_stems(docs, labels, max_rows) if labels is not None else {}
    return score_documents(docs, stems).where(F.col("toxicity") >= threshold)


def remove_toxic(docs: DataFrame, labels: DataFrame | None, threshold: float = THRESHOLD, max_rows: int = 20_000) -> DataFrame:
    """docs without its toxic rows, all columns as they were. The verdict is made row by row where the text is, so nothing is shuffled."""
    stems = learn_stems(docs, labels, max_rows) if labels is not None else {}
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(stems)
        for batch in batches:
            langs = batch.column("lang").to_pylist() if "lang" in names else [""] * batch.num_rows
            keep = [scorer.score(t or "", lang or "")[0] < threshold for t, lang in zip(batch.column("text").to_pylist(), langs, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_rows(small_batches(docs), releasing(run), docs.schema)
