"""URL filters (operator 1): rules first, gradient-boosted trees on lexical features for the rest.

Features of a url: lengths (url, host, path, query), path depth, host labels, digit ratio, character entropy,
parameter count, longest path segment, marks such as hyphens, a scheme flag, and smoothed block rates of its
host suffixes (one and two labels) and first path segment in the training urls.  Trees are depth-limited
regression trees on quantile bins, boosted on the logistic loss; training uses a bounded sample.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many labelled urls are used for training, by hash.
SAMPLE_URLS = 8000
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
#: Parts of the training urls whose statistics come from the others.
FOLDS = 5
#: A url is blocked from this probability on.
CUT = 0.5

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """``(host, path)``: host after the first ``://`` (A-Z lower-cased), path up to ``?``, ``#`` or the end."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = re.search(r"[/?#]", rest)
    host, rest = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    return host.translate(_LOWER), re.split(r"[?#]", rest, maxsplit=1)[0]


def host_of(url: str | None) -> str:
    return split_url(url)[0]


def _lower(c: F.Column) -> F.Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: F.Column) -> F.Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_column(url: F.Column) -> F.Column:
    """The native twin of ``split_url``'s host."""
    return F.coalesce(_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_column(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: F.Column, path: F.Column, rules: dict[str, str]) -> tuple[F.Column, F.Column]:
    """``(rule, verdict)`` of the longest rule that fits; null where none does.

    A rule is ``host/path``; it fits its host and all subdomains when the url's path starts with its path.  The
    rules are few and ordered by length, so they compile to one CASE expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):  # the longest is tested first: built last
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(rules[text])).otherwise(verdict)
    return rule, verdict


def _suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


def lexical(url: str | None) -> list[float]:
    url = url or ""
    host, path = split_url(url)
    tail = url.split("://", 1)[-1]
    query = tail.partition("?")[2].partition("#")[0]
    segments = [s for s in path.split("/") if s]
    n = len(url)
    counts = np.unique(np.frombuffer(url.encode("utf-8", "surrogatepass"), np.uint8), return_counts=True)[1] if n else np.empty(0)
    share = counts / counts.sum() if n else counts
    return [
        n,
        len(host),
        len(path),
        len(query),
        len(segments),
        host.count(".") + 1 if host else 0,
        sum(c.isdigit() for c in url) / n if n else 0.0,
        sum(c.isdigit() for c in host) / len(host) if host else 0.0,
        float(-(share * np.log2(share)).sum()) if n else 0.0,
        query.count("=") + query.count("&"),
        max(map(len, segments), default=0),
        url.count("-") + url.count("_"),
        float(url.lower().startswith("https:")),
        float("#" in url),
        float(bool(segments) and segments[-1].isdigit()),
        float(path.endswith("/")),
    ]


@dataclass
class Boosted:
    """Boosted trees over quantile-binned features; ``rates`` are the suffix and segment statistics."""

    base: float = 0.0
    prior: float = 0.5
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    rates: dict[str, float] = field(default_factory=dict)

    def features(self, urls: list[str | None], rates: list[dict[str, float]] | None = None) -> np.ndarray:
        rows = []
        for k, url in enumerate(urls):
            known = rates[k] if rates else self.rates
            rows.append(lexical(url) + [known.get(s, self.prior) for s in _statistics(url)])
        return np.array(rows, dtype=np.float64).reshape(len(urls), -1)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1)

    def _raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        rows = np.arange(len(bins))
        for feature, cut, value in self.trees:
            node = np.zeros(len(bins), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            out += value[node - (2**DEPTH - 1)]
        return out

    def probability(self, urls: list[str | None]) -> np.ndarray:
        """Probability of ``block`` for each url."""
        if not len(urls):
            return np.empty(0)
        raw = self._raw(self._bins(self.features(urls))) if self.trees else np.full(len(urls), self.base)
        return 1 / (1 + np.exp(-raw))


def _statistics(url: str | None) -> tuple[str, str, str]:
    host, path = split_url(url)
    one, two = _suffixes(host)
    return "1:" + one, "2:" + two, "s:" + path.split("/")[1] if path.count("/") else "s:"


def train(urls: list[str | None], block: list[int]) -> Boosted:
    """Fit on labelled urls; with one class (or none) the model returns its prior."""
    y = np.asarray(block, dtype=np.float64)
    model = Boosted()
    if not len(y):
        return model
    model.prior = float((y.sum() + 1) / (len(y) + 2))
    model.base = float(np.log(model.prior / (1 - model.prior)))
    totals: dict[str, np.ndarray] = {}  # blocked and all urls, by fold
    keys = [_statistics(u) for u in urls]
    folds = [zlib.crc32((u or "").encode("utf-8", "surrogatepass")) % FOLDS for u in urls]
    for parts, label, fold in zip(keys, y, folds, strict=True):
        for s in parts:
            totals.setdefault(s, np.zeros((FOLDS, 2)))[fold] += (label, 1)
    smooth = lambda t: float((t[0] + 8 * model.prior) / (t[1] + 8))
    model.rates = {s: smooth(t.sum(axis=0)) for s, t in totals.items()}
    if y.min() == y.max():
        return model
    # while training, a url's statistics come from the other folds: its own label, or the lack of it, tells nothing
    apart = {s: [smooth(t.sum(axis=0) - t[f]) for f in range(FOLDS)] for s, t in totals.items()}
    own = [{s: apart[s][fold] for s in parts} for parts, fold in zip(keys, folds, strict=True)]
    x = model.features(urls, own)
    model.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins, raw = model._bins(x), np.full(len(y), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        tree = _grow(bins, y - p, p * (1 - p))
        model.trees.append(tree)
        node = np.zeros(len(y), dtype=np.int64)
        rows = np.arange(len(y))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (bins[rows, tree[0][node]] > tree[1][node])
        raw += tree[2][node - (2**DEPTH - 1)]
    return model


def _grow(bins: np.ndarray, slope: np.ndarray, bend: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree of fixed depth, level by level, from histograms of slopes and bends (ridge 1)."""
    inner = 2**DEPTH - 1
    feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, BINS + 1)
    node = np.zeros(len(slope), dtype=np.int64)
    rows = np.arange(len(slope))
    for level in range(DEPTH):
        first, width = 2**level - 1, 2**level
        best = np.zeros(width)
        for f in range(bins.shape[1]):
            at = (node - first) * (BINS + 2) + bins[:, f]
            g = np.bincount(at, slope, width * (BINS + 2)).reshape(width, -1).cumsum(axis=1)
            h = np.bincount(at, bend, width * (BINS + 2)).reshape(width, -1).cumsum(axis=1)
            gt, ht = g[:, -1:], h[:, -1:]
            gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
            k = gain.argmax(axis=1)
            value = gain[np.arange(width), k]
            better = value > best + 1e-9
            best[better] = value[better]
            feature[first : first + width][better] = f
            cut[first : first + width][better] = k[better]
        node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
    leaf = node - inner
    g, h = np.bincount(leaf, slope, 2**DEPTH), np.bincount(leaf, bend, 2**DEPTH)
    return feature, cut, RATE * g / (h + 1)


def train_from(labelled: DataFrame, url_col: str = "url", label_col: str = "block") -> Boosted:
    """Train on at most SAMPLE_URLS rows, those of smallest hash: deterministic, spread over all rows.

    Null labels are ignored; the sample is half blocked and half allowed where both are that many.
    """
    rows = labelled.select(F.col(url_col).cast("string").alias("u"), F.col(label_col).cast("int").alias("y")).where("u IS NOT NULL AND y IS NOT NULL").distinct()
    got = [r for y in (0, 1) for r in rows.where(F.col("y") == y).orderBy(F.xxhash64("u"), "u").limit(SAMPLE_URLS // 2).collect()]
    return train([r["u"] for r in got], [r["y"] for r in got])


def _verdict_batches(packed: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(packed)
        for batch in batches:
            p = model.probability(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=["page_id", "url", "host", "path", "rule", "ruled", "probability"])

    return run


def judge(pages: DataFrame, rules: dict[str, str], model: Boosted, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, probability`` of every row.

    The longest fitting rule decides, else the model's probability.  Null urls and urls without ``://`` have an
    empty host and path and are judged by the model; repeated rows give repeated rows; an empty table gives an
    empty result; other columns are ignored.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), host_column(url).alias("host"), path_column(url).alias("path"))
    rule, ruled = rule_column(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": ruled})
    schema = "page_id long, url string, host string, path string, rule string, ruled string, probability double"
    scored = rows.mapInArrow(_verdict_batches(pickle.dumps(model)), schema)
    verdict = F.coalesce("ruled", F.when(F.col("probability") >= CUT, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "probability")


def labelled_by_rules(pages: DataFrame, rules: dict[str, str], url_col: str = "url") -> DataFrame:
    """``url, block``: the urls that a rule decides, as training labels."""
    url = F.col(url_col).cast("string")
    _, ruled = rule_column(host_column(url), path_column(url), rules)
    return pages.select(url.alias("url"), (ruled == "block").cast("int").alias("block")).where("block IS NOT NULL")
