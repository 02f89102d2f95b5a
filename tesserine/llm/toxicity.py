"""Toxicity classifier with counterfactual regularisation.

Fit on labelled texts, on a sample bounded by ``max_rows`` (the only bound here; scoring
covers every text whole).  A text is the set of its words and of their 4-, 5- and 6-byte
beginnings, so inflected forms of a stem count as evidence too.  For each labelled text that
names a group of people, a counterfactual copy swaps the name for another of its family; a
labelled text that names none is paired with itself, a name put into one copy and another of its
family into the other (families and names in turn, by the hash of the id).  The loss adds
``swap_penalty * (logit(text) - logit(copy))**2``, which takes the weight off names, and
off beginnings that they share with other words, that merely occur together with abuse.  Weights of all other features are kept at or
above zero under an L1 penalty: clean padding can't hide abuse, and length alone adds
nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec as V

MAX_ROWS, MIN_TEXTS, KEEP_FEATURES, THRESHOLD = 8000, 4, 6000, 0.4
PREFIXES = (4, 5, 6)

#: Families of group names; a name is swapped for the next of its family.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "sikhs"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual"),
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("female", "male"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab"),
    ("immigrant", "refugee", "foreigner", "native"), ("immigrants", "refugees", "foreigners", "natives"),
    ("american", "mexican", "chinese", "indian", "russian", "turkish", "french", "german", "spanish"),
    ("deaf", "blind", "disabled", "autistic"), ("old", "young"),
    ("frauen", "männer"), ("christen", "muslime", "juden"), ("ausländer", "flüchtlinge", "einwanderer"),
    ("femmes", "hommes"), ("chrétiens", "musulmans", "juifs"), ("immigrés", "réfugiés", "étrangers"),
    ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos"), ("inmigrantes", "refugiados", "extranjeros"),
)


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    threshold: float
    pairs: int = 0  # counterfactual pairs of the fit

    def filter_table(self) -> np.ndarray:
        t = np.zeros(1 << 20, dtype=bool)
        t[(self.features >> V.U64(44)).astype(np.int64)] = True
        return t


def _pieces(w: V.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, row) of the words, then of each length of beginning."""
    yield w.hash, w.row
    size = w.end - w.start
    for n in PREFIXES:
        long = np.flatnonzero(size > n)
        s = w.start[long]
        yield V.mix(w.span_hash(s, s + n) + V.U64(n)), w.row[long]


def features(col) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, hash, row): the distinct features of each row."""
    for w in V.words(col):
        h, r = zip(*_pieces(w))
        h, r = np.concatenate(h), np.concatenate(r)
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        first = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])] if len(h) else np.zeros(0, bool)
        yield w.lo, w.hi, h[first], r[first]


def swapper(families=IDENTITY_TERMS):
    """A function that swaps every group name of a text, or returns None where it has none."""
    to = {t: f[(i + 1) % len(f)] for f in families for i, t in enumerate(f)}
    pattern = re.compile(r"\b(" + "|".join(sorted(map(re.escape, to), key=len, reverse=True)) + r")\b", re.IGNORECASE)

    def swap(text: str | None) -> str | None:
        out, n = pattern.subn(lambda m: to[m.group(0).lower()], text or "")
        return out if n else None

    return swap


def fit(examples: list[tuple[int, np.ndarray, np.ndarray | tuple[np.ndarray, np.ndarray] | None]], *, swap_penalty: float = 2.0, l1: float = 2e-4, l2: float = 1e-4, steps: int = 400, families=IDENTITY_TERMS, threshold: float = THRESHOLD, min_texts: int = MIN_TEXTS, keep: int = KEEP_FEATURES) -> Model | None:
    """examples: (toxic, features, counterfactual).  The counterfactual is the features of the copy, or
    what each copy has beyond the other, or None.  No model (None) if a class is missing."""
    y = np.array([e[0] for e in examples], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return None
    ids, n = np.unique(np.concatenate([e[1] for e in examples]), return_counts=True)
    ids = ids[n >= min_texts]

    def rows(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        r = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        h = np.concatenate([*sets, np.zeros(0, np.uint64)])
        at = np.minimum(np.searchsorted(ids, h), max(len(ids) - 1, 0))
        ok = ids[at] == h if len(ids) else np.zeros(len(h), bool)
        return r[ok], at[ok]

    r, c = rows([e[1] for e in examples])
    pos = np.bincount(c, weights=y[r], minlength=len(ids))
    all_ = np.bincount(c, minlength=len(ids))
    share = y.mean()
    chi = (pos - all_ * share) / np.sqrt(all_ * share * (1 - share) + 1e-9)
    named = np.concatenate([w.hash for w in V.words(pa.array([t for f in families for t in f]))] or [np.zeros(0, np.uint64)])
    chi[np.isin(ids, named)] = np.inf
    best = np.sort(np.argsort(-chi, kind="stable")[:keep])
    ids, free = ids[best], np.isin(ids[best], named)
    r, c = rows([e[1] for e in examples])
    pair = [e[2] if isinstance(e[2], tuple) else (e[1], e[2]) for e in examples if e[2] is not None]
    ra, ca = rows([p[0] for p in pair])
    rb, cb = rows([p[1] for p in pair])
    m, k = len(y), len(ids)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max(m - y.sum(), 1))
    w, b = np.zeros(k), 0.0
    g2, gb2 = np.full(k, 1e-8), 1e-8
    for _ in range(steps):
        z = b + np.bincount(r, weights=w[c], minlength=m)
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g, gb = np.bincount(c, weights=e[r], minlength=k) + l2 * w, e.sum()
        if pair:
            d = np.bincount(ra, weights=w[ca], minlength=len(pair)) - np.bincount(rb, weights=w[cb], minlength=len(pair))
            d = d * (2 * swap_penalty / len(pair))
            g += np.bincount(ca, weights=d[ra], minlength=k) - np.bincount(cb, weights=d[rb], minlength=k)
        g2 += g * g
        gb2 += gb * gb
        step = 0.5 / np.sqrt(g2)
        w = w - step * g
        w = np.where(free, w, np.maximum(0, w - step * l1))
        b -= 0.5 / np.sqrt(gb2) * gb
    used = w != 0
    return Model(ids[used], w[used], float(b), threshold, len(pair))


def scores(model: Model, col) -> np.ndarray:
    """Probability of toxicity of every row of a text column; none where a text has no word."""
    table, z = model.filter_table(), np.full(len(col), -30.0)
    for w in V.words(col):
        z[w.lo + np.unique(w.row)] = model.bias
        hs, rs = [], []
        for h, r in _pieces(w):
            near = np.flatnonzero(table[(h >> V.U64(44)).astype(np.int64)])
            hs.append(h[near])
            rs.append(r[near])
        h, r = np.concatenate(hs), np.concatenate(rs)
        if len(h) and len(model.features):
            at = np.minimum(np.searchsorted(model.features, h), len(model.features) - 1)
            ok = model.features[at] == h
            hit = np.unique(r[ok] * np.int64(len(model.features)) + at[ok])
            np.add.at(z, w.lo + hit // len(model.features), model.weights[hit % len(model.features)])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, max_rows: int = MAX_ROWS, families=IDENTITY_TERMS, **settings) -> Model | None:
    """Fit on at most ``max_rows`` labelled texts, those of least hashed id.

    Ids are integers.  Rows with a null id, null text or null label are not learnt from; an id labelled
    twice counts as toxic if either row says so.  At most ``KEEP_FEATURES`` features, those that tell the
    classes apart best, of at least ``MIN_TEXTS`` labelled texts each, are fit.  Without both classes there is no model.
    """
    known = labels.select(labels[id_col].cast("long").alias("_id"), labels[label_col].cast("int").alias("_toxic")).where("_id is not null and _toxic is not null")
    known = known.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("_text")).where("_id is not null and _text is not null")
    rows = texts.join(F.broadcast(sample), "_id").select("_id", "_toxic", "_text")  # at most max_rows rows of two numbers

    def run(batches):
        swap = swapper(families) if families else (lambda text: None)
        names = [[np.unique(np.concatenate([h for _, _, h, _ in features(pa.array([t]))])) for t in f] for f in families]
        for b in batches:
            sets: list[bytes] = [b""] * b.num_rows
            for lo, hi, h, r in features(b.column(2)):
                for i, part in enumerate(np.split(h, np.searchsorted(r, np.arange(1, hi - lo)))):
                    sets[lo + i] = part.tobytes()
            twins = [swap(t) for t in b.column(2).to_pylist()]
            turn = V.mix(np.asarray(b.column(0)).astype(np.uint64))
            gap: list[tuple[np.ndarray, np.ndarray]] = []
            at = [i for i, t in enumerate(twins) if t is not None]
            other = dict(zip(at, (part for lo, hi, h, r in features(pa.array([twins[i] for i in at], pa.string())) for part in np.split(h, np.searchsorted(r, np.arange(1, hi - lo))))))
            for i in range(b.num_rows):
                own = np.frombuffer(sets[i], np.uint64)
                if i in other:
                    gap.append((np.setdiff1d(own, other[i]), np.setdiff1d(other[i], own)))
                elif names:
                    family = names[int(turn[i] % V.U64(len(names)))]
                    k = int((turn[i] >> V.U64(32)) % V.U64(len(family)))
                    gap.append(tuple(np.setdiff1d(np.setdiff1d(family[x], own), family[y]) for x, y in ((k, (k + 1) % len(family)), ((k + 1) % len(family), k))))
                else:
                    gap.append((own[:0], own[:0]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())] + [pa.array([g[k].tobytes() for g in gap], pa.binary()) for k in (0, 1)], ["_id", "toxic", "own", "plus", "minus"])

    got = rows.mapInArrow(run, "_id long, toxic int, own binary, plus binary, minus binary").toArrow()
    seen: dict[bytes, tuple] = {}
    order = np.argsort(got["_id"].to_numpy(), kind="stable")
    for i in order:
        own, plus, minus, toxic = (got[c][int(i)].as_py() for c in ("own", "plus", "minus", "toxic"))
        seen.setdefault(own, (int(toxic > 0), np.frombuffer(own, np.uint64), (np.frombuffer(plus, np.uint64), np.frombuffer(minus, np.uint64))))
    return fit(list(seen.values()), families=families, **settings)


def flag(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, toxicity) of each row judged toxic.  Ids are integers.  Null and empty texts and those
    without a word are never toxic; rows with a null id come out with a null id; repeated rows come
    out repeatedly.  Texts are scored whole; a score equal to
    the threshold is toxic; an empty table, or no model, gives no rows; other columns are never looked at."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("_text"))

    def run(batches):
        for b in batches:
            if model is None or b.num_rows == 0:
                continue
            s = scores(model, b.column(1))
            ok = pa.array(s >= model.threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "toxicity"]).filter(ok)

    return rows.mapInArrow(run, "doc_id long, toxicity double")


def drop_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows judged toxic, as by ``flag``; every column passes through, whatever its
    name, and so do all rows with a null or empty text, a null id, or a text repeated that stays.  An empty
    table stays empty; without a model nothing goes."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            if model is None or b.num_rows == 0:
                yield b
            else:
                yield b.filter(pa.array(scores(model, b.column(at)) < model.threshold))

    return docs.mapInArrow(run, docs.schema)
