"""Personal data in free text, found by a skip-chain conditional random field.

Variables are the candidate spans of a document (see ``mentions``), labels the kinds of mention or
none. Potentials: what a span and its surroundings look like, the labels of neighbouring
candidates (chain), and agreement of distant candidates that repeat a name, number, address or
number format (skip edges, from each occurrence to the next, so their number is linear). Loopy
belief propagation over all documents of a batch at once gives the labels.

The weights are fitted by pseudo-likelihood on a bounded sample of documents, in which candidates
that strict rules can name (listed names, announced numbers, well-formed addresses) carry a label;
all others are left open, and the fitted model decides them everywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinolith.llm.mentions import ADDRESS, EMAIL, ID, KINDS, PERSON, PHONE, Candidate, Lexicon, candidates, fold

#: Documents of the sample that the weights are fitted on, and the longest text taken into it.
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 20_000
#: Hashed features, labels, rounds of message passing, steps of the fit.
FEATURES, LABELS, ROUNDS, STEPS = 1 << 15, len(KINDS), 6, 150
#: Kinds of skip edges by the first letter of their key: family name, whole name, number, number format, email, address.
SKIPS = "pqnfea"

#: Words that announce an identity number, and words that count or name something else.
ANNOUNCE = frozenset(
    "ssn social security sociale sécurité passport passeport pasaporte licence license id identité identity ausweisnummer"
    " personalausweis steuer dni nie national number nr no".split()
)
COUNTERS = frozenset("seed build run clip frame take step ticket moved".split())
FILES = frozenset("png jpg jpeg gif svg webp mp4 json".split())


def _label(c: Candidate) -> int | None:
    """The label that strict rules give a candidate, None where they don't decide."""
    marks = set(c.marks)
    words = {m[2:] for m in c.marks if m.startswith("w=")}
    if EMAIL in c.kinds:
        return 0 if any(f"ending={x}" in marks for x in FILES) else EMAIL
    if ADDRESS in c.kinds:
        return ADDRESS
    if PERSON in c.kinds:
        order = c.marks[0].split("=")[1].split()
        if order[0] != "FG" and all(x == "listed" for x in order[1:]):
            return PERSON
        return None
    formats = {m[7:] for m in c.marks if m.startswith("format=")}
    if any(f"b1={x}" in marks for x in COUNTERS):
        return 0
    if "plus=True" in marks and formats & {"intl", "us", "uk", "de", "fr", "es"}:
        return PHONE
    if words & ANNOUNCE and ID in c.kinds:
        return ID
    if c.kinds == {PHONE} and formats & {"us", "uk", "fr", "es", "de"}:
        return PHONE
    if formats & {"ssn", "licence", "insee"}:
        return ID
    return None


class Graph:
    """Candidates of several documents with chain and skip edges."""

    def __init__(self, documents: list[list[Candidate]]) -> None:
        self.nodes = [c for d in documents for c in d]
        n = len(self.nodes)
        width = max([len(c.marks) for c in self.nodes], default=0) + 1
        self.features = np.full((n, width), FEATURES, np.int64)  # FEATURES: none
        self.allowed = np.zeros((n, LABELS), bool)
        chain, skip, kinds = [], [], []
        at = 0
        for doc in documents:
            last: dict[str, int] = {}
            for k, c in enumerate(doc):
                i = at + k
                kind = "".join(map(str, sorted(c.kinds)))
                row = [zlib.crc32(f"{kind}|{m}".encode()) % FEATURES for m in c.marks]
                row.append(zlib.crc32(kind.encode()) % FEATURES)
                self.features[i, : len(row)] = row
                self.allowed[i, [0, *c.kinds]] = True
                if k:
                    chain.append((i - 1, i))
                for key in c.keys:
                    if key in last:
                        skip.append((last[key], i))
                        kinds.append(SKIPS.index(key[0]))
                    last[key] = i
            at += len(doc)
        self.chain = np.array(chain, np.int64).reshape(-1, 2)
        self.skip = np.array(skip, np.int64).reshape(-1, 2)
        self.skip_kind = np.array(kinds, np.int64)


class Model:
    """Weights of the field: features by label, neighbours, agreement along skip edges."""

    def __init__(self) -> None:
        self.unary = np.zeros((FEATURES + 1, LABELS))
        self.pair = np.zeros((LABELS, LABELS))
        self.agree = np.zeros((len(SKIPS), LABELS))

    def scores(self, g: Graph) -> np.ndarray:
        theta = self.unary[g.features].sum(axis=1)
        theta[~g.allowed] = -1e9
        return theta

    def fit(self, g: Graph, labels: np.ndarray, steps: int = STEPS, rate: float = 0.5, decay: float = 1e-4) -> None:
        """Pseudo-likelihood with adaptive steps; label -1 is open and says nothing to its neighbours."""
        known = labels >= 0
        if not known.any():
            return
        hot = np.zeros((len(labels), LABELS))
        hot[known, labels[known]] = 1
        squares = [np.full_like(w, 1e-8) for w in (self.unary, self.pair, self.agree)]
        u, v = self._ends(g.chain)
        a, b = self._ends(g.skip)
        flat = g.features[known].ravel()
        for _ in range(steps):
            theta = self.scores(g)
            np.add.at(theta, v, hot[u] @ self.pair)
            np.add.at(theta, u, hot[v] @ self.pair.T)
            np.add.at(theta, b, hot[a] * self.agree[g.skip_kind])
            np.add.at(theta, a, hot[b] * self.agree[g.skip_kind])
            theta[~g.allowed] = -1e9
            p = np.exp(theta - theta.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = (hot - p) * known[:, None]
            grad = np.zeros_like(self.unary)
            np.add.at(grad, flat, np.repeat(error[known], g.features.shape[1], axis=0))
            grad[FEATURES] = 0
            pair = hot[u].T @ error[v] + error[u].T @ hot[v]
            agree = np.zeros_like(self.agree)
            np.add.at(agree, g.skip_kind, hot[a] * error[b] + hot[b] * error[a])
            scale = 1 / known.sum()
            for w, d, sq in zip((self.unary, self.pair, self.agree), (grad, pair, agree), squares):
                d = d * scale - decay * w
                sq += d * d
                w += rate * d / np.sqrt(sq)

    @staticmethod
    def _ends(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return edges[:, 0], edges[:, 1]

    def decode(self, g: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Labels by loopy sum-product message passing, all edges at once, damped by half."""
        theta = self.scores(g)
        if not len(theta):
            return np.zeros(0, np.int64)
        edges = np.concatenate([g.chain, g.skip])
        n = len(edges)
        if not n:
            return theta.argmax(axis=1)
        table = np.zeros((n, LABELS, LABELS))
        table[: len(g.chain)] = self.pair
        places = np.arange(LABELS)
        table[len(g.chain) :, places, places] = self.agree[g.skip_kind]
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        message = np.zeros((2 * n, LABELS))
        for _ in range(rounds):
            total = theta.copy()
            np.add.at(total, target, message)
            x = (total[source] - message[back])[:, :, None] + table
            top = x.max(axis=1)
            new = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
            message = (message + new - new.max(axis=1, keepdims=True)) / 2
        np.add.at(theta, target, message)
        theta[~g.allowed] = -1e9
        return theta.argmax(axis=1)


def fit_model(texts: list[str], lexicon: Lexicon) -> Model:
    """Fit the weights on the texts of the sample."""
    documents = [candidates(fold(t), lexicon) for t in texts]
    g = Graph(documents)
    labels = np.array([-1 if (x := _label(c)) is None else x for c in g.nodes], np.int64)
    model = Model()
    model.fit(g, labels)
    return model


def sample_of(documents: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[str]:
    """At most ``docs`` texts of at most ``chars`` characters, by the order of a hash of their id."""
    some = documents.where(F.length("text").between(1, chars)).select("text", F.xxhash64("doc_id", "text").alias("h"))
    return [r.text for r in some.orderBy("h").limit(docs).collect()]


_MENTIONS = "array<struct<kind:string,start_at:int,end_at:int>>"


def find(documents: DataFrame, names: DataFrame, masked: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Mentions of every document: doc_id, the columns ``keep``, mentions and, if ``masked``, the masked text.

    mentions: kind, start_at and end_at (code points, end exclusive), by place, not overlapping. In
    the masked text each mention is replaced by ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]``
    or ``[PERSON]``; all else is as it was. Null texts have no mentions and stay null; empty ones
    stay empty. Every row is scanned whole, by itself. ``names`` (word, name_kind) is a fixed list
    and goes to every executor, as do the weights (1.6 MB). Without documents nothing is found.
    """
    spark = documents.sparkSession
    listed = [(r.word, r.name_kind) for r in names.where("word IS NOT NULL").select("word", "name_kind").distinct().collect()]
    given, family = sorted(w for w, k in listed if k == "given"), sorted(w for w, k in listed if k == "family")
    model = fit_model(sample_of(documents), Lexicon(given, family))
    shared = spark.sparkContext.broadcast((given, family, model.unary, model.pair, model.agree))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start_at", pa.int32()), ("end_at", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, family, unary, pair, agree = shared.value
        lexicon, model = Lexicon(given, family), Model()
        model.unary, model.pair, model.agree = unary, pair, agree
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                some = batch.slice(begin, 500)
                texts = some.column(some.num_columns - 1).to_pylist()
                found = [candidates(fold(t), lexicon) if t else [] for t in texts]
                labels = model.decode(Graph(found)).tolist()
                rows, clean, at = [], [], 0
                for text, doc in zip(texts, found):
                    hits = [(KINDS[y], c.start, c.end) for c, y in zip(doc, labels[at : at + len(doc)]) if y]
                    at += len(doc)
                    rows.append([{"kind": k, "start_at": s, "end_at": e} for k, s, e in hits])
                    if masked:
                        out, last = [], 0
                        for k, s, e in hits:
                            out += [text[last:s], f"[{k.upper()}]"]
                            last = e
                        clean.append(None if text is None else "".join([*out, text[last:]]))
                columns = [*some.columns[:-1], pa.array(rows, kind)] + ([pa.array(clean, pa.string())] if masked else [])
                yield pa.RecordBatch.from_arrays(columns, names=[*some.schema.names[:-1], "mentions"] + ["text"] * masked)

    held = documents.select("doc_id", *keep, "text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1]]
    schema = ", ".join([*fields, f"mentions {_MENTIONS}"] + ["text string"] * masked)
    return held.mapInArrow(run, schema)


def mention_rows(found: DataFrame) -> DataFrame:
    """One row a mention: doc_id, kind, start_at."""
    return found.select("doc_id", F.explode("mentions").alias("m")).select("doc_id", "m.kind", "m.start_at")


def mention_report(found: DataFrame) -> DataFrame:
    """Mentions and documents that hold some, per source and kind (null source kept)."""
    rows = found.select("source", "doc_id", F.explode("mentions.kind").alias("kind"))
    return rows.groupBy("source", "kind").agg(F.count("*").alias("n_mentions"), F.count_distinct("doc_id").alias("n_docs"))
