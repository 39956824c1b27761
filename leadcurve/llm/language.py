"""Language identification by string kernels: n-gram presence, Nystroem landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadcurve.llm.blocks import sorted_sets
from leadcurve.llm.work import ship, tidy

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
#: The sample to learn from: so many texts a language, so many in all (but some of each), none longer than this.
SAMPLE_PER_LANG, SAMPLE_TEXTS, SAMPLE_LEAST = 240, 4800, 16
SAMPLE_MAX_CHARS = 20_000
LANDMARKS_PER_LANG = 32
#: Up to so many codes, a table of all of them says which are known; beyond, they are looked up among the known ones.
TABLE_CODES = 1 << 24
RIDGE = 1e-3
#: Of held-out texts all but this share must count as in a learned language, and how much more of a text may be unknown than of those.
STRANGE_SHARE = 0.01
STRANGE_MARGIN = 0.1
#: Fewer held-out texts than this say nothing; then this part of a text may be unknown.
STRANGE_LEAST, STRANGE_DEFAULT = 50, 0.9
BATCH = 256
BATCH_CHARS = 150_000
SCHEMA = "doc_id bigint, lang_pred string, score double"


@lru_cache(maxsize=2)
def _letter_table(letters: str) -> np.ndarray:
    """For each code point 0 (no letter), 1.. (a letter of the alphabet, either case) or the highest number (another letter)."""
    place = {c: i + 1 for i, c in enumerate(letters)}
    other = len(letters) + 1
    table = np.zeros(0x110000, np.int32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            table[code] = place.get(c.lower(), other)
    return table


def ngrams(texts: list[str], letters: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of every text as codes, their bounds, and whether a text has a letter.

    Letters count in lower case; a run of anything else is one blank, as is
    the start of a text. Every order of ``ORDERS`` has a range of codes of
    its own.
    """
    size = len(letters) + 2
    lengths = np.array([len(t) + 1 for t in texts])
    codes = np.frombuffer("".join([" " + t for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = _letter_table(letters)[codes].astype(np.int64)
    text = np.repeat(np.arange(len(texts)), lengths)
    keep = ids > 0
    has_letter = np.bincount(text[keep], minlength=len(texts)) > 0
    keep[1:] |= keep[:-1]
    keep[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = True
    ids, text = ids[keep], text[keep]
    parts, owners, offset = [], [], 0
    gram = np.zeros(len(ids), np.int64)
    for order in range(1, max(ORDERS) + 1):
        gram = gram[: len(ids) - order + 1] * size + ids[order - 1 :]
        inside = text[: len(gram)] == text[order - 1 :]
        if order == 1:
            inside &= ids > 0
        if order in ORDERS:
            parts.append(gram[inside] + offset)
            owners.append(text[: len(gram)][inside])
        offset += size**order
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order], np.searchsorted(owner[order], np.arange(len(texts) + 1)), has_letter


def ngram_sets(texts: list[str], letters: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of every text as ascending codes, their bounds, and whether a text has a letter."""
    values, bounds, has_letter = ngrams(texts, letters)
    return *sorted_sets(values, bounds), has_letter


@dataclass
class Model:
    """langs; letters; the landmarks' n-grams as ascending codes; presence matrix (n-gram x landmark); projection and intercept."""

    langs: list[str]
    letters: str
    known: np.ndarray
    presence: np.ndarray
    sizes: np.ndarray
    projection: np.ndarray
    intercept: np.ndarray
    #: The share of unknown n-grams up to which a text is in a learned language.
    stray: float = STRANGE_DEFAULT

    def __post_init__(self):
        codes = sum((len(self.letters) + 2) ** o for o in range(1, max(ORDERS) + 1))
        self.table = None
        if codes <= TABLE_CODES:
            self.table = np.full(codes, -1, np.int32)
            self.table[self.known] = np.arange(len(self.known))

    def features(self, values: np.ndarray) -> np.ndarray:
        """The place of every code among the landmarks' n-grams, -1 for those that none has."""
        if self.table is not None:
            return self.table[values]
        at = np.searchsorted(self.known, values)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == values, at, -1) if len(self.known) else np.full(len(values), -1)

    def kernels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Presence kernel of every text with every landmark, by one matrix product; and whether a text has a letter."""
        values, bounds, has_letter = ngrams(texts, self.letters)
        return self._kernels(values, bounds), has_letter

    def unknown(self, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of every text's n-grams of the highest order no landmark has, and how many there are; of order 2 in a text that has none."""
        size = len(self.letters) + 2
        strange = self.features(values) < 0
        starts = np.cumsum([0, *(size**o for o in range(1, max(ORDERS)))])
        counts = []
        for low, high in ((starts[2], np.iinfo(np.int64).max), (starts[1], starts[2])):
            own = (values >= low) & (values < high)
            sums = np.zeros((2, len(values) + 1), np.int64)
            np.cumsum(own & strange, out=sums[0, 1:])
            np.cumsum(own, out=sums[1, 1:])
            counts.append(sums[:, bounds[1:]] - sums[:, bounds[:-1]])
        return tuple(np.where(counts[0][1] > 0, *counts))

    def _kernels(self, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        values, bounds = sorted_sets(values, bounds)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        feature = self.features(values)
        known = feature >= 0
        present = np.zeros((len(bounds) - 1, len(self.presence)), np.float32)
        present[text[known], feature[known]] = 1
        scale = np.sqrt(np.maximum(np.diff(bounds), 1)[:, None] * self.sizes[None, :])
        return (present @ self.presence) / scale

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Each text's language, its score, and whether its n-grams are those of a learned language at all."""
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        values, bounds, has_letter = ngrams(texts, self.letters)
        none, of = self.unknown(values, bounds)
        # two standard deviations more, as a short text has few n-grams
        known = has_letter & (none <= self.stray * of + 2 * np.sqrt(self.stray * (1 - self.stray) * of))
        margins = self._kernels(values, bounds) @ self.projection + self.intercept
        best = margins.argmax(1)
        score = np.clip((1 + margins[np.arange(len(texts)), best]) / 2, 0, 1)
        return [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best, has_letter, strict=True)], np.where(has_letter, score, 0.0), known


def fit(sample: list[tuple[str, str]], landmarks_per_lang: int = LANDMARKS_PER_LANG, ridge: float = RIDGE) -> Model:
    """Learns from rows (lang, text). The first texts of each language are the landmarks."""
    letters = {c for _, text in sample for c in set(text.lower()) if c.isalpha()}
    alphabet = "".join(sorted(letters))
    langs = sorted({lang for lang, _ in sample})
    marks = [t for lang in langs for t in [x for own, x in sample if own == lang][:landmarks_per_lang]]
    if not langs:
        return Model(langs, alphabet, np.zeros(0, np.int64), *[np.zeros((0, 0), np.float32)] * 4)
    values, bounds, _ = ngram_sets(marks, alphabet)
    known = np.unique(values)
    presence = np.zeros((len(known), len(marks)), np.float32)
    presence[np.searchsorted(known, values), np.repeat(np.arange(len(marks)), np.diff(bounds))] = 1
    model = Model(langs, alphabet, known, presence, np.maximum(np.diff(bounds), 1).astype(np.float32), np.zeros(0), np.zeros(0))
    among, _ = model.kernels(marks)
    weight, vectors = np.linalg.eigh(among.astype(np.float64))
    root = vectors * np.where(weight > 1e-6 * weight.max(), 1 / np.sqrt(np.maximum(weight, 1e-12)), 0)
    texts = [t for _, t in sample]
    mapped = np.concatenate([model.kernels(texts[i : i + BATCH])[0] for i in range(0, len(texts), BATCH)]) @ root
    target = np.where(np.array([lang for lang, _ in sample])[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    # languages count alike, whatever their share of the sample
    share = Counter(lang for lang, _ in sample)
    w = np.array([1 / share[lang] for lang, _ in sample])
    w /= w.sum()
    centre, middle = w @ mapped, w @ target
    x, y = mapped - centre, target - middle
    weights = np.linalg.solve((x * w[:, None]).T @ x + ridge * np.eye(x.shape[1]), (x * w[:, None]).T @ y)
    model.projection, model.intercept = root @ weights, middle - centre @ weights
    # texts that are no landmarks are held out from what counts as known
    seen: Counter = Counter()
    held: dict[str, list[str]] = {}
    for lang, text in sample:
        seen[lang] += 1
        if seen[lang] > landmarks_per_lang:
            held.setdefault(lang, []).append(text)
    if sum(map(len, held.values())) >= STRANGE_LEAST:
        shares = []
        for own in held.values():
            counts = [model.unknown(*ngrams(own[i : i + BATCH], alphabet)[:2]) for i in range(0, len(own), BATCH)]
            none, of = (np.concatenate(x) for x in zip(*counts, strict=True))
            shares.append(np.quantile(none / np.maximum(of, 1), 1 - STRANGE_SHARE))
        model.stray = min(float(max(shares)) + STRANGE_MARGIN, 0.9)
    return model


def training_sample(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, max_chars: int = SAMPLE_MAX_CHARS) -> list[tuple[str, str]]:
    """At most ``per_lang`` texts of each language, those with the lowest hashes, in that order.

    With many languages fewer of each, so that all are ``SAMPLE_TEXTS`` at
    most, but ``SAMPLE_LEAST`` of each. Rows are counted by language first; a threshold on the hash then lets
    about twice the wanted number through, and only those come to the driver.
    """
    fit_for = docs.where((F.length("text") <= max_chars) & (F.length("text") > 0) & F.col("lang").isNotNull()).select("lang", "text", F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 40)).alias("h"))
    counts = {r.lang: r["count"] for r in fit_for.groupBy("lang").count().collect()}
    if not counts:
        return []
    per_lang = min(per_lang, max(SAMPLE_TEXTS // len(counts), SAMPLE_LEAST))
    chance = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(min(1, (2 * per_lang + 20) / n) * (1 << 40)))])
    rows = sorted((r.lang, r.h, r.text) for r in fit_for.where(F.col("h") < chance[F.col("lang")]).collect())
    taken: Counter = Counter()
    out = []
    for lang, _, text in rows:
        taken[lang] += 1
        if taken[lang] <= per_lang:
            out.append((lang, text))
    return out


def learn(docs: DataFrame, **options) -> Model:
    """A model from a bounded sample of the labelled rows of ``docs`` (doc_id, text, lang)."""
    return fit(training_sample(docs), **options)


def _predicted(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Predictions for a column of texts, some at a time."""
    langs: list[str] = []
    scores, known = [np.zeros(0)], [np.zeros(0, bool)]
    for start in range(0, len(column), BATCH):
        texts = [t or "" for t in column.slice(start, BATCH).to_pylist()]
        at = 0
        while at < len(texts):
            to, chars = at + 1, len(texts[at])
            while to < len(texts) and chars + len(texts[to]) <= BATCH_CHARS:
                chars += len(texts[to])
                to += 1
            found, score, sound = model.predict(texts[at:to])
            langs += found
            scores.append(score)
            known.append(sound)
            at = to
    return langs, np.concatenate(scores), np.concatenate(known)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every whole text.

    A text's set of letter n-grams of orders 1 to 3 is held against the
    landmarks' sets: kernel = shared n-grams / root of the product of both
    sizes. Batches of texts go through one matrix product for the kernels and
    one for the languages' regressions. The language with the highest value
    wins, the first by name of equals; score is that value taken from -1..1
    to 0..1. A null text, or one without a letter, is ``und`` with score 0,
    and so is every text if nothing was learned. Repeated rows give repeated
    rows; only doc_id and text are read.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, _ = _predicted(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), SCHEMA)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents in a learned language, all their columns, lang as identified.

    Texts that are null or without a letter go, as do those with more
    n-grams that no landmark has than held-out labelled texts allow (another
    script or language, encoded data, random letters).
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [c.lower() for c in docs.columns]
    text, lang = names.index("text"), names.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, _, known = _predicted(shared.value, batch.column(text))
            columns = list(batch.columns)
            columns[lang] = pa.array(langs, batch.schema.field(lang).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(known))

    return docs.mapInArrow(tidy(run), docs.schema)
