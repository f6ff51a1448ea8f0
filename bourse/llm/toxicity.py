"""Toxicity scores from a fuzzy lexicon with context windows.

A lexicon of terms that mark toxic documents is learned from a bounded sample
of labelled rows (near copies counted once, G-squared test, at most
``max_terms`` terms). Its trie is intersected with Levenshtein automata: a
state holds the trie nodes reachable so far with the edits spent on each, so
one walk over a word tests it against every term at once. States are built
when first met and kept as a transition table, so the distinct words of a
block are walked together, one character at a time, by table look-ups.

Terms of 5 to 7 characters allow one edit, from 8 on two, shorter ones none. A
misspelling that the sample shows in clean documents is an ordinary word and
is left out. Each hit weighs the term's log-odds, less per edit; the
surrounding ``WINDOW`` words tell quotation (quotation marks around it,
reporting words) from abuse (a direct address). Sums over the document feed a
logistic unit fitted on the same sample.

Whole texts are scored in one Arrow pass without a shuffle; the model is a few
kilobytes in the task closure.

Edge cases: null and empty texts have no hit and get the unit's base score;
without labelled rows every score is 0.5, with one class its share; a null
doc_id is not held out; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourse.llm import textcols as T
from bourse.llm.sampling import labelled_sample

WINDOW = 8
WORD = T.byte_table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
# Words that report speech, words that address the reader, quotation marks.
REPORTING = set("said says quote quoted quotes called wrote term word slur sagte nannte wort dit mot terme dijo palabra".split())
ADDRESS = set("you your yours youre u dich dein deine ihr euch toi ton vous votre eres tu usted".split())
QUOTES = "\"“”„«»‘’"
FEATURES = 6
MOST_STATES = 20_000       # of an automaton; a call adds those of its own words


def lower_words(d: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the two-byte capitals of Latin-1 in lower case."""
    low = T.LOWER[d]
    if len(low) > 1:
        at = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[at] += 0x20
    return low


class Automaton:
    """Levenshtein automata of all terms over their trie, determinised as words need it."""

    def __init__(self, terms: list[str], weights: list[float]) -> None:
        self.terms, self.weights = terms, weights
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted(set("".join(terms))))}   # 0: any other character
        self.children: list[dict[int, int]] = [{}]
        self.term: list[int] = [-1]
        self.room = [0]                                    # most edits that a term below a node allows
        for t, term in enumerate(terms):
            node, room = 0, allowed(term)
            self.room[0] = max(self.room[0], room)
            for ch in term:
                c = self.alphabet[ch]
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.room.append(0)
                node = self.children[node][c]
                self.room[node] = max(self.room[node], room)
            self.term[node] = t
        self._fresh()

    def _fresh(self) -> None:
        """No states but the dead one and the start."""
        self.ids: dict[tuple, int] = {}
        self.sets: list[dict[int, int]] = []
        self.best: list[tuple[int, int]] = []              # (term or -1, edits) of a word that ends here
        self.table = np.full((1024, len(self.alphabet) + 1), -1, np.int32)
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes.items())
        while todo:                                        # characters left out of the word
            node, e = todo.pop()
            if nodes.get(node, 9) < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.room[child] and e + 1 < nodes.get(child, 9):
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted(nodes.items()))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(nodes)
            hits = [(e, -self.weights[self.term[n]], self.term[n]) for n, e in nodes.items()
                    if self.term[n] >= 0 and e <= allowed(self.terms[self.term[n]])]
            self.best.append((min(hits)[2], min(hits)[0]) if hits else (-1, 0))
            if len(self.sets) > len(self.table):
                self.table = np.vstack([self.table, np.full_like(self.table, -1)])
        return self.ids[key]

    def _step(self, state: int, c: int) -> int:
        out: dict[int, int] = {}
        for node, e in self.sets[state].items():
            if e + 1 <= self.room[node] and e + 1 < out.get(node, 9):
                out[node] = e + 1                          # a character too many
            for ch, child in self.children[node].items():
                cost = e + (ch != c)
                if cost <= self.room[child] and cost < out.get(child, 9):
                    out[child] = cost
        return self._state(out)

    def match(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Term (-1: none) and edits of every word. States beyond MOST_STATES are dropped between calls."""
        if len(self.sets) > MOST_STATES:
            self._fresh()
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        size = int(codes.max()) + 1 if len(codes) else 1
        lookup = np.zeros(max(size, 1), np.int32)
        for ch, i in self.alphabet.items():
            if ord(ch) < size:
                lookup[ord(ch)] = i
        codes = lookup[codes]
        length = np.array([len(w) for w in words])
        first = np.cumsum(length) - length
        state = np.full(len(words), self.start, np.int32)
        alive, pos = np.flatnonzero(length > 0), 0
        while len(alive):
            at, c = state[alive], codes[first[alive] + pos]
            nxt = self.table[at, c]
            missing = np.flatnonzero(nxt < 0)
            if len(missing):
                for s, k in np.unique(np.stack([at[missing], c[missing]], 1), axis=0).tolist():
                    to = self._step(s, k)
                    self.table[s, k] = to
                nxt = self.table[at, c]
            state[alive] = nxt
            pos += 1
            alive = alive[(nxt != self.dead) & (length[alive] > pos)]
        best = np.array(self.best, np.int64).reshape(-1, 2)
        return best[state, 0], best[state, 1]


def allowed(term: str) -> int:
    """Edits that a term allows."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


_ready: dict[tuple, tuple] = {}


def _matcher(model: dict) -> tuple[Automaton, set[str]]:
    told = "\0".join([*model["terms"], "\1", *map(repr, model["weights"]), "\1", *sorted(model["ordinary"])])
    key = (hashlib.blake2b(told.encode(), digest_size=16).digest(),)
    if key not in _ready:                                  # kept between the tasks of one worker
        _ready.clear()
        _ready[key] = (Automaton(model["terms"], model["weights"]), set(model["ordinary"]))
    return _ready[key]


def features(data: np.ndarray, off: np.ndarray, model: dict) -> np.ndarray:
    """Hit features of every document of a block."""
    automaton, ordinary = _matcher(model)
    n = len(off) - 1
    out = np.zeros((n, FEATURES))
    low = lower_words(data)
    s, e = T.spans(WORD[low], off)
    if not len(s) or not model["terms"]:
        return out
    h = T.span_hash(T.prefix_hash(low), s, e)
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    raw = low.tobytes()
    longest = max(map(len, model["terms"])) + 2
    fits = e[first] - s[first] <= 4 * longest
    words = [raw[a:b].decode("utf-8", "replace") if ok else "" for a, b, ok in
             zip(s[first].tolist(), e[first].tolist(), fits.tolist(), strict=True)]
    term, edits = automaton.match(words)
    for u in np.flatnonzero((term >= 0) & (edits > 0)):
        if words[u] in ordinary:
            term[u] = -1
    hit = np.flatnonzero(term[back] >= 0)
    if not len(hit):
        return out
    doc = T.owners(off, s)
    count = np.bincount(doc, minlength=n)
    begin = np.cumsum(count) - count
    for i in hit.tolist():
        d = doc[i]
        lo, hi = max(i - WINDOW, begin[d]), min(i + WINDOW + 1, begin[d] + count[d])
        around = {words[x] for x in back[lo:hi].tolist()}
        before = raw[s[lo]:s[i]].decode("utf-8", "replace")
        after = raw[e[i]:e[hi - 1]].decode("utf-8", "replace")
        quoted = (sum(map(before.count, QUOTES)) % 2 == 1 and any(q in after for q in QUOTES)) or bool(around & REPORTING)
        k, spent = term[back[i]], edits[back[i]]
        score = model["weights"][k] * (1.0, 0.7, 0.5)[spent] * (0.5 if quoted else 1.0) * (
            1.2 if around & ADDRESS else 1.0)
        out[d] += (0, score, 1, spent > 0, quoted, 0)
        out[d, 0] = max(out[d, 0], score)
    rate = out[:, 2] / np.maximum(count, 1)
    out[:, 1:5] = np.log1p(out[:, 1:5])
    out[:, 5] = np.minimum(1, 20 * rate)
    return out


def _feature_rows(data: np.ndarray, off: np.ndarray, model: dict) -> np.ndarray:
    parts = [features(d, o, model) for _, _, d, o in T.blocks(data, off, 1 << 22)]
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES))


def _count_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold a word, summed up per batch."""
    for batch in it:
        data, off = T.column(batch, "text")
        y = batch.column(batch.schema.get_field_index("y")).to_pylist()
        found: dict[bytes, list[int]] = {}
        for i, j, d, o in T.blocks(data, off):
            low = lower_words(d)
            s, e = T.spans(WORD[low], o)
            raw, doc = low.tobytes(), T.owners(o, s)
            cut = np.searchsorted(doc, np.arange(j - i + 1))
            for x in range(j - i):
                a, b = cut[x], cut[x + 1]
                for w in {raw[p:q] for p, q in zip(s[a:b].tolist(), e[a:b].tolist(), strict=True)}:
                    found.setdefault(w, [0, 0])[y[i + x]] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode("utf-8", "replace") for w in found], pa.string()),
             pa.array([c[0] for c in found.values()], pa.int64()),
             pa.array([c[1] for c in found.values()], pa.int64())], names=["word", "clean", "toxic"])


def _copy_keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest 5-word hash of each text: equal for most near copies."""
    for batch in it:
        data, off = T.column(batch, "text")
        for i, j, d, o in T.blocks(data, off):
            low = lower_words(d)
            s, e = T.spans(WORD[low], o)
            doc = T.owners(o, s)
            g, at = T.gram_hash(T.span_hash(T.prefix_hash(low), s, e), doc, 5)
            key = np.arange(j - i).astype(np.uint64) + np.uint64(i)
            key = T.mix(key + np.uint64(len(d)))
            counts = np.bincount(doc[at], minlength=j - i)
            full = np.flatnonzero(counts)
            if len(full):
                key[full] = np.minimum.reduceat(g, (np.cumsum(counts) - counts)[full])
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(key.view(np.int64))],
                                             names=[*part.schema.names, "copy"])


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the offset."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        move = np.linalg.solve(hess, a.T @ (p - y) + ridge * w)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep, *, max_rows: int = 20000, max_terms: int = 512,
                 min_g2: float = 20.0) -> dict:
    """Lexicon and logistic unit from at most ``max_rows`` labelled rows for which ``keep`` holds."""
    sample = (labelled_sample(docs, labels, "toxic", keep, max_rows)
              .mapInArrow(_copy_keys, "doc_id long, text string, y int, copy long")
              .dropDuplicates(["copy", "y"]).checkpoint())
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    model = {"terms": [], "weights": [], "ordinary": [], "unit": None, "constant": None}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return model | {"constant": 0.5 if not n else float(bool(n1))}
    words = (sample.select("text", "y").mapInArrow(_count_words, "word string, clean long, toxic long")
             .groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).checkpoint())
    share = n1 / (n0 + n1)
    total = F.col("clean") + F.col("toxic")

    def part(k, p):
        return F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (total * p))).otherwise(F.lit(0.0))

    g2 = 2 * (part("toxic", share) + part("clean", 1 - share))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    top = (words.where((F.col("toxic") >= 3) & (F.length("word") >= 3) & (F.length("word") <= 40))
           .withColumn("g2", g2).withColumn("odds", odds).where((F.col("odds") > 1.5) & (F.col("g2") >= min_g2))
           .orderBy(F.desc("g2"), "word").limit(max_terms).collect())
    model |= {"terms": [r["word"] for r in top], "weights": [round(r["odds"], 6) for r in top]}

    def ordinary(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(model["terms"], model["weights"])
        for batch in it:
            ws = batch.column(0).to_pylist()
            term, edits = automaton.match(ws)
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, t, e in zip(ws, term, edits, strict=True) if t >= 0 and e > 0], pa.string())],
                names=["word"])

    if model["terms"]:
        # clean words within the edits of a term; bounded by the sample
        seen = words.where("clean > 0 AND length(word) <= 42").select("word").mapInArrow(ordinary, "word string")
        model["ordinary"] = sorted(r["word"] for r in seen.collect())

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = _feature_rows(*T.column(batch, "text"), model)
            yield pa.RecordBatch.from_arrays(
                [*T.keep_columns(batch, ["doc_id", "y"]), T.ragged(x.reshape(-1), np.full(len(x), FEATURES), pa.float64())],
                names=["doc_id", "y", "x"])

    got = sample.select("doc_id", "text", "y").mapInArrow(rows, "doc_id long, y int, x array<double>").orderBy(
        "doc_id", "y").collect()                           # at most max_rows rows of six numbers
    model["unit"] = logistic(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float)).tolist()
    return model


def score_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if model["constant"] is not None:
                score = np.full(batch.num_rows, model["constant"])
            else:
                x = _feature_rows(*T.column(batch, "text"), model)
                z = x @ np.array(model["unit"][:-1]) + model["unit"][-1]
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*T.keep_columns(batch, ["doc_id"]), pa.array(score)],
                                             names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, keep, held_out, *, threshold: float = 0.3, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted."""
    model = fit_toxicity(docs, labels, keep, **options)
    return score_toxicity(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
