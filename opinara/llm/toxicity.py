"""Toxicity (operator 10): compression distance between two zstandard dictionaries.

From a bounded, documented sample of labelled rows two dictionaries are trained: the *ordinary* one by zstd's
trainer on windows of ordinary documents, the *toxic* one from the word beginnings that occur far more often
in toxic documents of the sample than in ordinary ones of their language (see ``contrast``), followed by the
ordinary dictionary's content without them.  Beginnings of words are marked (see ``marked``).  A window (a few
words) is compressed once with each; because the shared content sits at the same distance from the window in
both, a window only gets shorter under the toxic dictionary where it repeats toxic material.  A document's
windows cover its whole text; the score is a logistic calibration, fitted on the sample, of its gains.
"""

from __future__ import annotations

import os
import pickle
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import store

#: At most so many labelled rows of each class are sampled for training, by hash of the id; their texts are read whole.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 1500, 3000
WINDOW_WORDS = 12
#: About so many windows train the ordinary dictionary.
MOST_WINDOWS = 20_000
#: Letters at the beginning of a word that are told apart from the same letters inside a word.
MARKED = 5
CUT = 0.7
#: Twice the log-likelihood ratio from which a word beginning counts as toxic (chance among a million: under 1).
LEAST_EVIDENCE = 60.0
_ORDINARY_BYTES = 16 * 1024
_TOXIC_BYTES = 8 * 1024
#: Bytes of the shortest word beginning.
LEAST_PIECE = 4

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_FOLD[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20


def _folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with blanks for white space, one blank before each text; and each text's offset."""
    parts = [b" " + (t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return _FOLD[np.frombuffer(b"".join(parts), dtype=np.uint8)], at


def windows(texts: list[str | None], words: int = WINDOW_WORDS) -> tuple[bytes, np.ndarray, np.ndarray]:
    """``(data, segments, owner)``: runs of ``words`` words, each with the blank before it, covering all texts."""
    data, at = _folded(texts)
    blank = data == 0x20
    begins = np.flatnonzero(blank[:-1] & ~blank[1:])  # the blank before a word
    owner = np.searchsorted(at, begins, "right") - 1
    first = np.searchsorted(begins, at[:-1])
    opens = (np.arange(len(begins)) - first[owner]) % words == 0
    starts, owner = begins[opens], owner[opens]
    ends = np.append(starts[1:], len(data))
    ends = np.minimum(ends, at[owner + 1])
    return data.tobytes(), np.stack([starts, ends - starts], axis=1).astype("<u8"), owner


def marked(data: bytes) -> bytes:
    """Folded bytes with the first letters of each word in capitals: the inside of a word matches no beginning.

    Works on single bytes, so a long text takes a few times its own size.
    """
    out = np.frombuffer(data, dtype=np.uint8).copy()
    blank = np.concatenate([[True], out == 0x20])  # a blank stands before the data
    near = np.zeros(len(out), dtype=bool)
    for k in range(min(MARKED, len(out))):
        near[k:] |= blank[: len(out) - k]
    near &= (out >= 0x61) & (out <= 0x7A)
    out[near] -= 0x20
    return out.tobytes()


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    words: int = WINDOW_WORDS

    def compressors(self):
        import zstandard as zstd

        made = []
        for content in (self.ordinary, self.toxic):
            dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            parameters = zstd.ZstdCompressionParameters(
                strategy=zstd.STRATEGY_BTOPT, min_match=5, window_log=17, hash_log=15, chain_log=15, search_log=5,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            dictionary.precompute_compress(compression_params=parameters)
            made.append(zstd.ZstdCompressor(dict_data=dictionary, compression_params=parameters))
        return made

    def gains(self, texts: list[str | None], compressors=None) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that each window saves under the toxic dictionary, and its text's index."""
        import zstandard as zstd

        data, segments, owner = windows(texts, self.words)
        if not len(segments):
            return np.empty(0), owner
        held = zstd.BufferWithSegments(marked(data), segments.tobytes())
        plain, toxic = (np.fromiter(map(len, c.multi_compress_to_buffer(held, threads=1)), dtype=np.int64, count=len(segments)) for c in compressors or self.compressors())
        return (plain - toxic).astype(np.float64), owner

    def scores(self, texts: list[str | None], compressors=None) -> np.ndarray:
        return _logistic(features(*self.gains(texts, compressors), len(texts)) @ np.array(self.weights))


def features(gain: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Per text: 1, logs of the total gain, of gains beyond one byte a window, and of the gain a window."""
    saved = np.maximum(gain, 0)
    total = np.bincount(owner, weights=saved, minlength=texts)
    count = np.bincount(owner, minlength=texts)
    strong = np.bincount(owner, weights=np.maximum(saved - 1, 0), minlength=texts)
    return np.stack([np.ones(texts), np.log1p(total), np.log1p(strong), np.log1p(20 * total / np.maximum(count, 1))], axis=1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Class-balanced ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(40):
        p = _logistic(x @ w)
        slope = x.T @ (share * (y - p)) - keep * w
        bend = (x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(bend, slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _words(text: str) -> list[bytes]:
    return _FOLD[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].tobytes().split() if text else []


def _pieces(texts: list[str]) -> set[bytes]:
    """Beginnings (four bytes at least, of any length) at which words of the texts part, and whole words.

    Any other beginning is continued in one way only, so its longest continuation stands for it: there are at
    most two pieces a distinct word, however long words are.
    """
    vocabulary = sorted({w for t in texts for w in set(_words(t))})
    out = {w for w in vocabulary if len(w) >= LEAST_PIECE}
    for one, other in zip(vocabulary, vocabulary[1:], strict=False):
        k = len(os.path.commonprefix((one, other)))
        if k >= LEAST_PIECE:
            out.add(one[:k])
    return out


class _Beginnings:
    """The pieces that begin a word, remembered by word."""

    def __init__(self, pieces: set[bytes]):
        self.pieces, self.lengths, self.held = pieces, sorted({len(p) for p in pieces}), {}

    def of(self, word: bytes) -> tuple[bytes, ...]:
        if (got := self.held.get(word)) is None:
            got = self.held[word] = tuple(word[:k] for k in self.lengths[: bisect_right(self.lengths, len(word))] if word[:k] in self.pieces)
        return got

    def texts(self, texts: list[str]) -> Counter:
        """In how many texts each piece begins a word."""
        out: Counter = Counter()
        for t in texts:
            out.update({p for w in set(_words(t)) for p in self.of(w)})
        return out

    def places(self, texts: list[str]) -> tuple[Counter, int]:
        """How often each piece begins a word, and how many words there are.

        A word counts once for each word that stands before it: copies repeat a word with its surroundings.
        """
        out: Counter = Counter()
        pairs = set()
        for t in texts:
            words = _words(t)
            pairs.update(zip([b"", *words], words, strict=False))
        for _, word in pairs:
            out.update(self.of(word))
        return out, len(pairs)


def contrast(toxic: list[str], ordinary: list[str], toxic_langs: list | None = None, ordinary_langs: list | None = None) -> list[bytes]:
    """Word beginnings that occur far more often in toxic texts than in ordinary ones of their language, best first.

    A piece is judged inside each language, by its occurrences: at least three toxic texts hold it, it occurs ten
    times as often a word as in ordinary texts, and with LEAST_EVIDENCE.  Windows know no language, so over all
    languages together it must also occur ten times as often as expected.
    """
    toxic_langs, ordinary_langs = toxic_langs or [None] * len(toxic), ordinary_langs or [None] * len(ordinary)
    langs = sorted(set(toxic_langs), key=str)
    bad = {g: [t for t, x in zip(toxic, toxic_langs, strict=True) if x == g] for g in langs}
    fine = {g: [t for t, x in zip(ordinary, ordinary_langs, strict=True) if x == g] for g in langs}
    finder = _Beginnings(_pieces(toxic))
    held = {g: {p for p, n in finder.texts(bad[g]).items() if n >= 3} for g in langs}
    finder = _Beginnings(set().union(*held.values()))
    here, there = ({g: finder.places(side[g]) for g in langs} for side in (bad, fine))
    share = {g: here[g][1] / (there[g][1] + 1) for g in langs}
    best: dict[bytes, tuple] = {}
    for g in langs:
        for p in held[g]:
            n, expected = here[g][0][p], share[g] * (there[g][0][p] + 1)
            overall = share[g] + sum(share[x] * there[x][0][p] for x in langs)
            if n < max(3, 10 * expected) or sum(here[x][0][p] for x in langs) < 10 * overall:
                continue
            evidence = 2 * (n * np.log(n / expected) - (n - expected))
            if evidence >= LEAST_EVIDENCE:
                best[p] = max(best.get(p, (0.0, 0)), (evidence, n))
    rows = sorted(((evidence, len(p), b" " + p, n) for p, (evidence, n) in best.items()), key=lambda r: (-r[0], -r[1], r[2]))
    chosen: dict[bytes, int] = {}
    size = 0
    for _, _, piece, n in rows:
        if any(piece in c or piece.startswith(c) for c in chosen):
            continue
        if size + len(piece) <= _TOXIC_BYTES:
            chosen[piece] = n
            size += len(piece)
    return list(chosen)


def train(texts: list[str], toxic: list[int], langs: list | None = None) -> Model:
    """Dictionaries and calibration from labelled texts (and their languages, where known).

    Without both classes a model that scores 0.
    """
    import zstandard as zstd

    texts = [t or "" for t in texts]
    langs = langs or [None] * len(texts)
    bad, fine = [t for t, y in zip(texts, toxic, strict=True) if y], [t for t, y in zip(texts, toxic, strict=True) if not y]
    bad_in, fine_in = [g for g, y in zip(langs, toxic, strict=True) if y], [g for g, y in zip(langs, toxic, strict=True) if not y]
    if not bad or not fine:
        return Model(b" " * 8, b" " * 8, (-30.0, 0.0, 0.0, 0.0))
    data, segments, owner = windows(fine)
    data = marked(data)
    # windows spread evenly over each whole text, no more of one text than of another: long texts do not rule
    count = np.bincount(owner, minlength=len(fine))
    spread = np.maximum(1, -(-count * len(fine) // MOST_WINDOWS))
    place = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    samples = [data[a : a + n] for a, n in segments[place % spread[owner] == 0].tolist()]
    try:
        ordinary = zstd.train_dictionary(_ORDINARY_BYTES, samples).as_bytes()
    except zstd.ZstdError:  # too little text for the trainer: the text itself
        ordinary = data[-_ORDINARY_BYTES:]

    def built(bad: list[str], fine: list[str], bad_in: list, fine_in: list) -> tuple[bytes, bytes]:
        pieces = [marked(p) for p in contrast(bad, fine, bad_in, fine_in)]
        shared = ordinary
        for piece in pieces:  # what is toxic is not ordinary, wherever the trainer found it
            shared = shared.replace(piece, b" " * len(piece))
        return shared, b"".join(reversed(pieces)) + b" " * 8 + shared

    # calibrated on halves that did not choose the dictionary, then the dictionary is rebuilt from both
    rows, marks = [], []
    for half in (0, 1):
        chosen = (bad[half::2] or bad, fine[half::2] or fine, bad_in[half::2] or bad_in, fine_in[half::2] or fine_in)
        part = Model(*built(*chosen), (0.0,) * 4)
        held = [*(bad[1 - half :: 2] or bad), *(fine[1 - half :: 2] or fine)]
        rows.append(features(*part.gains(held), len(held)))
        marks.append(np.array([1.0] * len(bad[1 - half :: 2] or bad) + [0.0] * len(fine[1 - half :: 2] or fine)))
    weights = _fit_logistic(np.concatenate(rows), np.concatenate(marks))
    return Model(*built(bad, fine, bad_in, fine_in), tuple(weights.tolist()))


def held_out(doc_id) -> F.Column:
    """Documents whose crc32(doc_id as text) mod 3 is 1 are never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang") -> Model:
    """Train on at most SAMPLE_TOXIC + SAMPLE_ORDINARY labelled rows outside the held-out third.

    The sample is the rows of smallest hash of their id in each class: bounded, deterministic, spread over all
    rows.  A document with several labels counts as toxic if one says so; null labels are ignored.  Where ``docs``
    has no language column all texts count as one language.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where("i IS NOT NULL AND y IS NOT NULL")
    marks = marks.where(~held_out(F.col("i"))).groupBy("i").agg(F.max("y").alias("y"))
    chosen = [r for y, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY)) for r in marks.where((F.col("y") > 0) == F.lit(bool(y))).orderBy(F.xxhash64("i"), "i").limit(most).collect()]
    mark = {r["i"]: int(r["y"] > 0) for r in chosen}
    if not mark:
        return train([], [])
    want = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in mark], "i long"))  # <= SAMPLE rows
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"), lang.alias("g")).join(want, "i", "left_semi")
    rows = sorted({(r["i"], r["t"] or "", r["g"] or "") for r in texts.collect()})
    return train([t for _, t, _ in rows], [mark[i] for i, _, _ in rows], [g for _, _, g in rows])


def score_batches(packed: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(packed)
        compressors = model.compressors()
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1).to_pylist(), compressors))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id long, held_out boolean, score double, predicted int`` of every row, from its whole text only.

    Null and empty texts score as texts without any gain; repeated rows give repeated rows; null ids are kept
    (not held out); an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(store.trimmed(score_batches(pickle.dumps(model))), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def crc32_mod3(doc_id: int) -> int:
    """The split rule on the driver, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 3


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` (all columns, whatever their names) without the rows that the model predicts toxic."""
    packed, width = pickle.dumps(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(packed)
        compressors = model.compressors()
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                keep = model.scores(part.column(width).to_pylist(), compressors) < CUT
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(store.trimmed(run), docs.schema)
