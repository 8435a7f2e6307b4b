"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortal.llm.jaccard import shingles
from cohortal.llm.text import FEW_ROWS, MAX_KNOWN, small_batches
from cohortal.session import materialize

# Words of abuse in four languages, by kind. Each list is one voter.
LEXICONS = {
    "en insult": "idiot idiots stupid moron morons imbecile imbeciles dumb dumbass fool fools jerk jerks clown clowns loser losers retard retards halfwit simpleton",
    "en contempt": "pathetic worthless disgusting useless trash garbage filth filthy scum vermin parasite parasites pig pigs rat rats creep creeps freak freaks",
    "en profanity": "bastard bastards bitch bitches asshole assholes dickhead prick whore slut fuck fucking fucker shit shitty bullshit crap",
    "en threat": "kill hang strangle exterminate destroy hurt punish burn",
    "de insult": "idiot idioten dumm dumme dummer dummkopf trottel blödmann schwachkopf depp versager vollidiot spinner",
    "de contempt": "abschaum widerlich ekelhaft wertlos erbärmlich jämmerlich dreck ungeziefer gesindel pack schmarotzer",
    "de profanity": "arschloch arsch drecksau hurensohn schlampe wichser scheiße scheiss scheißkerl miststück",
    "fr insult": "idiot idiote imbécile imbéciles crétin crétins débile débiles abruti abrutis bouffon stupide nul",
    "fr contempt": "ordure ordures minable minables dégoûtant pourriture raclure vermine déchet misérable parasite",
    "fr profanity": "connard connards connasse salaud salauds salope putain merde enculé bâtard",
    "es insult": "idiota idiotas imbécil imbéciles estúpido estúpida estúpidos tonto tonta tontos payaso payasos inútil inútiles tarado",
    "es contempt": "basura escoria patético patética asqueroso asquerosa despreciable miserable gentuza alimaña parásito",
    "es profanity": "gilipollas cabrón cabrones puta putas mierda pendejo hijoputa maricón zorra",
}
_WORST = "idiot|stupid|moron|loser|scum|trash|clown|pathetic|worthless|disgusting|fool|imbecile|pig|filth"
_WORST_DE, _WORST_FR, _WORST_ES = "idiot|trottel|versager|arschloch|dummkopf|abschaum", "idiot|imbécile|crétin|connard|salaud|ordure", "idiota|imbécil|estúpid|basura|escoria|payaso"
#: Pattern voters read the whole text, if one of its tokens has the anchor, without which the pattern cannot match.
PATTERNS = {
    "address": (_WORST, rf"\b(?:you|your|you're|u)\W+(?:\w+\W+){{0,2}}?(?:{_WORST})"),
    "called": (_WORST, rf"\b(?:such|what|another|total|complete|utter)\W+(?:an?\W+)?(?:{_WORST})"),
    "hate": (r"\b(?:hate|kill|destroy)\b", r"\b(?:hate|kill|destroy)\W+(?:you|them|yourself)\b"),
    "dismissal": (r"\b(?:shut|hell|lost|screw|drop|nobody)\b", r"\b(?:shut up|go to hell|get lost|screw you|drop dead|nobody (?:likes|wants) you)\b"),
    "masked": (r"\w[*@#$]{2,}\w", r"\w[*@#$]{2,}\w"),
    "piled": (_WORST, rf"\b(?:{_WORST})\W+(?:and\W+)?(?:{_WORST})"),
    "loud": (_WORST, rf"\b(?:{_WORST})\w*\s*!{{2,}}"),
    "de address": (_WORST_DE, rf"\b(?:du|ihr|sie)\W+(?:\w+\W+){{0,2}}?(?:{_WORST_DE})"),
    "de dismissal": (r"\b(?:klappe|fresse|verpiss|hölle)\b", r"\b(?:halt die (?:klappe|fresse)|verpiss dich|fahr zur hölle)\b"),
    "fr address": (_WORST_FR, rf"\b(?:(?:tu|vous|espèce de)\W+|espèce d')(?:\w+\W+){{0,2}}?(?:{_WORST_FR})"),
    "fr dismissal": (r"\b(?:gueule|ferme|faire|casse)\b", r"\b(?:ta gueule|ferme-la|va te faire|casse-toi)\b"),
    "es address": (_WORST_ES, rf"\b(?:tú|eres|usted|son)\W+(?:\w+\W+){{0,2}}?(?:{_WORST_ES})"),
    "es dismissal": (r"\b(?:cállate|vete|puta|jodan)\b", r"\b(?:cállate|vete a la|hijo de puta|que te jodan)\b"),
}
#: All anchors but that of "masked" stand at the start of a word with one of these beginnings.
ANCHOR_HEADS = frozenset(w[:3] for a, _ in PATTERNS.values() for w in re.findall(r"\w{3,}", a.replace(r"\b", " ")))
MASKED = re.compile(r"[*@#$]{2}")
ANCHORS = [re.compile(a) for a, _ in PATTERNS.values()]
ANY_ANCHOR = re.compile("|".join(f"(?:{a})" for a in dict.fromkeys(a for a, _ in PATTERNS.values())))
COMPILED = [re.compile(p, re.I) for _, p in PATTERNS.values()]
TOKEN = re.compile(r"\w+")
PREFIXES = (3, 4, 5, 6)


def token_features(token: str) -> list[str]:
    """Features of one white-space token: its words, and their beginnings marked by ``*``."""
    out = []
    for w in TOKEN.findall(token):
        out.append(w)
        out += [f"{w[:k]}*" for k in PREFIXES if len(w) > k]
    return out


def heads_of(wanted: dict[str, tuple[int, ...]]) -> frozenset[str]:
    """First three characters of the wanted features and of the anchors: a word with others has neither."""
    return ANCHOR_HEADS | {f[:3] for f in wanted}


def text_features(
    text: str | None, memo: dict[str, tuple], wanted: dict[str, tuple[int, ...]] | None = None, heads: frozenset[str] | None = None
) -> set:
    """Distinct features of a text, or the numbers of those that are wanted.

    Among the numbers are -1 - k for the k-th pattern if a token has its anchor. ``heads`` (see
    ``heads_of``) spares most tokens a closer look.
    """
    found: set = set()
    for token in set((text or "").lower().split()):
        own = memo.get(token)
        if own is None:
            if len(memo) > MAX_KNOWN:
                memo.clear()
            if heads is not None and not MASKED.search(token) and not any(w[:3] in heads for w in TOKEN.findall(token)):
                memo[token] = ()
                continue
            own = token_features(token)
            if wanted is not None:
                own = [i for f in own if f in wanted for i in wanted[f]]
                if ANY_ANCHOR.search(token):
                    own += [-1 - k for k, anchor in enumerate(ANCHORS) if anchor.search(token)]
            own = memo[token] = tuple(own)
        if own:
            found.update(own)
    return found


@dataclass
class Rows:
    """A sparse table of zeros and ones: the columns of the ones, row by row, and weights of the rows."""

    at: np.ndarray
    row: np.ndarray
    n: int
    width: int
    times: np.ndarray

    @classmethod
    def of(cls, fired: Sequence[Sequence[int]], width: int, times: Sequence[float] | None = None) -> Rows:
        at = np.fromiter((i for f in fired for i in f), np.int64)
        row = np.repeat(np.arange(len(fired)), [len(f) for f in fired])
        return cls(at, row, len(fired), width, np.ones(len(fired)) if times is None else np.asarray(times, float))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n)

    def sums(self, w: np.ndarray) -> np.ndarray:
        """Per column the sum of row weights ``w`` over its ones."""
        return np.bincount(self.at, w[self.row], self.width)


@dataclass
class LabelModel:
    """A generative model of voters that fire or abstain, given a hidden class.

    A voter fires at a rate of its class; to abstain says nothing, as a voter of another language
    has nothing to say. Where two voters go together beyond what the class explains, one's
    rate also depends on whether the other fires. These pairs are the edges of a forest:
    of all pairs with a likelihood ratio above ``edge_gain``, a maximum spanning forest of
    the ratios. ``fit`` estimates rates and pair rates by expectation maximisation over all
    rows, labelled or not. Known labels only calibrate it: they give the balance of the
    classes and a prior of the voters' rates that weighs up to ``calibration`` rows a class.
    No label is a vote on its own row.
    """

    prior: float = 0.1
    calibration: float = 1_000.0
    edge_gain: float = 12.0
    shift: float = 0.0
    rates: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))
    parent: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    single: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))
    paired: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))

    def fit(self, votes: Rows, labels: np.ndarray, rounds: int = 60) -> np.ndarray:
        """Posterior of class 1 per row; ``labels`` has 0, 1 or -1 (unknown)."""
        k, times = votes.width, votes.times
        known = [times * (labels == y) for y in (0, 1)]
        among, self.shift = times, 0.0
        if known[0].sum() and known[1].sum():
            among = known[0] + known[1]
            base = np.stack([(votes.sums(w) + c) / (w.sum() + 1) for w, c in zip(known, (0.05, 0.5), strict=True)])
            strength = np.array([min(self.calibration, w.sum()) for w in known])
            share = known[1].sum() / (known[0].sum() + known[1].sum())
        else:
            # Nobody says which class is which: the more voters fire the likelier, but one that mostly fires says nothing.
            rare = (votes.sums(times) / max(times.sum(), 1) < 0.5).astype(float)
            guess = 1 - 0.4 ** votes.dot(rare)
            guess = np.where(guess > 0, guess, self.prior / 2)
            base = np.stack([(votes.sums(w) + c) / (w.sum() + 1) for w, c in ((times * (1 - guess), 0.1), (times * guess, 0.5))])
            strength, share = np.array([2.0, 2.0]), self.prior
        self.parent = np.full(k, -1)
        self.prior, self.rates = float(np.clip(share, 1e-4, 1 - 1e-4)), np.clip(base, 1e-6, 1 - 1e-6)
        both = np.zeros((2, k))
        self._set(both, np.zeros((2, k)), np.ones(2), strength)
        post = self.posterior(votes)
        for r in range(rounds):
            w = np.stack([1 - post, post]) * times
            if r == 2:
                self.parent = self.forest(votes, w)
            total = w.sum(1)
            fires = np.stack([votes.sums(x) for x in w])
            self.rates = np.clip((fires + strength[:, None] * base) / (total + strength)[:, None], 1e-6, 1 - 1e-6)
            pairs = self._pairs(votes)
            both = np.stack([np.bincount(votes.at[pairs], x[votes.row[pairs]], k) for x in w])
            self._set(both, fires, total, strength)
            self._balance(votes, among)
            new = self.posterior(votes)
            done = r > 3 and np.abs(new - post).max() < 1e-6
            post = new
            if done:
                break
        return post

    def _balance(self, votes: Rows, among: np.ndarray) -> None:
        """Shift the log-odds so that the mean posterior of some rows is the prior.

        As abstentions say nothing, only this keeps the classes from growing into each other.
        With labels these rows are the labelled ones, and the prior their share of class 1.
        """
        low, high = -60.0, 60.0
        for _ in range(60):
            self.shift = (low + high) / 2
            if np.average(self.posterior(votes), weights=among) > self.prior:
                high = self.shift
            else:
                low = self.shift

    def _pairs(self, votes: Rows) -> np.ndarray:
        """Which ones of the table have a parent that fires in the same row."""
        up = self.parent[votes.at]
        return np.flatnonzero((up >= 0) & np.isin(votes.row * votes.width + up, votes.row * votes.width + votes.at))

    def _set(self, both: np.ndarray, fires: np.ndarray, total: np.ndarray, strength: np.ndarray) -> None:
        """Log rates of a vote by class: without its parent's vote, and what that adds."""
        k = len(self.parent)
        self.single, self.paired = np.log(self.rates), np.zeros((2, k))
        child = np.flatnonzero(self.parent >= 0)
        up = self.parent[child]
        for y in (0, 1):
            r = self.rates[y, child]
            # The prior of a pair: both are independent, with the weight of the voters' own prior.
            m = strength[y] * self.rates[y, up] + 2
            rest = strength[y] * (1 - self.rates[y, up]) + 2
            with_up = np.clip((both[y, child] + m * r) / (fires[y, up] + m), 1e-6, 1 - 1e-6)
            without = np.clip((fires[y, child] - both[y, child] + rest * r) / (total[y] - fires[y, up] + rest), 1e-6, 1 - 1e-6)
            self.single[y, child] = np.log(without)
            self.paired[y, child] = np.log(with_up) - np.log(without)

    def forest(self, votes: Rows, w: np.ndarray) -> np.ndarray:
        """Parent of each voter (-1: none) in the forest of the strongest dependences given the class."""
        k = votes.width
        total, fires = w.sum(1), np.stack([votes.sums(x) for x in w])
        together: dict[int, np.ndarray] = {}
        starts = np.searchsorted(votes.row, np.arange(votes.n + 1))
        for i in range(votes.n):
            own = np.sort(votes.at[starts[i] : starts[i + 1]])
            for x in range(len(own) - 1):
                for key in (own[x] * k + own[x + 1 :]).tolist():
                    if key in together:
                        together[key] += w[:, i]
                    else:
                        together[key] = w[:, i].copy()
        edges = []
        for key, n11 in together.items():
            i, j = divmod(key, k)
            gain = 0.0
            for y in (0, 1):
                cells = [n11[y], fires[y, i] - n11[y], fires[y, j] - n11[y], total[y] - fires[y, i] - fires[y, j] + n11[y]]
                a, b, n = fires[y, i], fires[y, j], total[y]
                alone = [a * b / n, a * (n - b) / n, (n - a) * b / n, (n - a) * (n - b) / n] if n > 0 else cells
                gain += 2 * sum(c * math.log(c / e) for c, e in zip(cells, alone, strict=True) if c > 1e-9 and e > 1e-9)
            if gain > self.edge_gain:
                edges.append((-gain, i, j))
        label = list(range(k))

        def find(x: int) -> int:
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        near: dict[int, list[int]] = {}
        for _, i, j in sorted(edges):
            x, y = find(i), find(j)
            if x != y:
                label[max(x, y)] = min(x, y)
                near.setdefault(i, []).append(j)
                near.setdefault(j, []).append(i)
        parent = np.full(k, -1)
        seen: set[int] = set()
        for root in sorted(near):
            if root in seen:
                continue
            seen.add(root)
            line = [root]
            for x in line:
                for y in near[x]:
                    if y not in seen:
                        seen.add(y)
                        parent[y] = x
                        line.append(y)
        return parent

    def posterior(self, votes: Rows) -> np.ndarray:
        z = self.shift + math.log(self.prior / (1 - self.prior)) + votes.dot(self.single[1] - self.single[0])
        pairs = self._pairs(votes)
        z += np.bincount(votes.row[pairs], (self.paired[1] - self.paired[0])[votes.at[pairs]], votes.n)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_linear(x: Rows, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression on soft labels; the last is the bias.

    Newton steps solved by conjugate gradients, so that nothing is as large as the square of the width.
    """
    w, penalty = np.zeros(x.width + 1), np.full(x.width + 1, ridge)
    penalty[-1] = 1e-3
    ahead = lambda v: x.dot(v[:-1]) + v[-1]
    back = lambda r: np.append(x.sums(r), r.sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(ahead(w), -30, 30)))
        curve = x.times * p * (1 - p)
        right = back(x.times * (y - p)) - penalty * w
        step, left, size = np.zeros_like(w), right.copy(), right @ right
        scale = penalty + back(curve)
        z = left / scale
        along, size = z.copy(), left @ z
        for _ in range(200):
            if np.abs(left).max() < 1e-8:
                break
            bent = back(curve * ahead(along)) + penalty * along
            rate = size / (along @ bent)
            step += rate * along
            left -= rate * bent
            z = left / scale
            size, before = left @ z, size
            along = z + size / before * along
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class ToxicityModel:
    """Columns of the text features and the weights of the classifier; the label model for reference."""

    columns: dict[str, tuple[int, ...]]
    n_words: int
    weights: np.ndarray
    labels: LabelModel | None = None

    def score(self, fired: Sequence[int]) -> float:
        z = self.weights[-1] + sum(self.weights[i] for i in fired)
        return 1 / (1 + math.exp(-min(max(z, -50.0), 50.0)))


def fired_of(
    text: str | None, memo: dict, wanted: dict[str, tuple[int, ...]], n_words: int, heads: frozenset[str] | None = None
) -> list[int]:
    """Numbers of what fires in a text: words and beginnings first, then patterns from ``n_words`` on."""
    found = text_features(text, memo, wanted, heads)
    return sorted([i if i >= 0 else n_words - 1 - i for i in found if i >= 0 or COMPILED[-1 - i].search(text)])


def voter_numbers(mined: Sequence[str]) -> tuple[dict[str, tuple[int, ...]], int]:
    """Voters: mined features, then the lexicons. A mined word that a lexicon has fires for both."""
    out: dict[str, tuple[int, ...]] = {f: (i,) for i, f in enumerate(mined)}
    for k, words in enumerate(LEXICONS.values()):
        for w in words.split():
            out[w] = (*out.get(w, ()), len(mined) + k)
    return out, len(mined) + len(LEXICONS)


def text_columns(features: Sequence[str]) -> tuple[dict[str, tuple[int, ...]], int]:
    """Columns of the classifier: one per feature and per word of a lexicon."""
    words = dict.fromkeys([*features, *(w for ws in LEXICONS.values() for w in ws.split())])
    return {f: (i,) for i, f in enumerate(words)}, len(words)


def held_out(id: str | Column, folds: int = 5) -> Column:
    """Rows whose crc32 of the id as text leaves 0: never used in learning (null ids: of '')."""
    id = F.col(id) if isinstance(id, str) else id
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit(""))), F.lit(folds)) == 0


#: Texts whose features a task counts together.
MINED_ROWS = 250
#: Soft labels are summed in whole units, so that the order of tasks leaves no trace.
UNITS = 1_000


def mine_features(sample: DataFrame, min_toxic: int = 5, min_precision: float = 0.5) -> list[str]:
    """Words and beginnings of words that mark toxic rows of a bounded sample of distinct texts.

    ``toxic`` may be a label or a probability. Kept are all features whose share of toxic rows is
    surely (lower Wilson bound) over ``min_precision``; of features that mark the same rows (by
    the xor of the rows' hashes) the shortest. The surest come first: no word whose beginning is
    kept, and no beginning that is only precise where a longer feature is. Counting, the
    bound and the folding are done on Spark; the driver gets one feature per marked set of rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        # Portions of a batch: what a task counts at a time stays small.
        for b in (b.iloc[lo : lo + MINED_ROWS] for b in batches for lo in range(0, len(b), MINED_ROWS)):
            n: Counter = Counter()
            t: Counter = Counter()
            x: dict[str, int] = {}
            for text, toxic, row in zip(b["text"], b["toxic"], b["row"], strict=True):
                found = text_features(text, memo)
                n.update(found)
                units = round(toxic * UNITS)
                row = int(row)
                for f in found:
                    x[f] = x.get(f, 0) ^ row
                    if units:
                        t[f] += units
            names = list(n)
            if names:  # an empty frame has no kinds of columns
                yield pd.DataFrame({"feature": names, "n": [n[f] for f in names], "t": [t[f] for f in names], "x": [x[f] for f in names]})

    rows = sample.select("text", F.col("toxic").cast("double").alias("toxic"), F.xxhash64("text").alias("row"))
    counts = rows.mapInPandas(run, "feature string, n long, t long, x long")
    sums = counts.groupBy("feature").agg(F.sum("n").alias("n"), (F.sum("t") / UNITS).alias("t"), F.bit_xor("x").alias("x"))
    precise = sums.where(F.col("t") >= min_toxic).withColumn("low", surely(F.col("t"), F.col("n"))).where(F.col("low") > min_precision)
    name = F.struct(F.length("feature").alias("k"), "feature")
    folded = precise.groupBy("n", "x").agg(F.max("t").alias("t"), F.max("low").alias("low"), F.min(name).alias("f"))
    chosen: dict[str, tuple[float, int]] = {}
    longer: dict[str, tuple[float, int]] = {}  # per beginning, its most frequent longer feature
    for r in sorted(folded.select("n", "t", "low", "f.*").collect(), key=lambda r: (-r.low, r.k, r.feature)):
        stem = r.feature.rstrip("*")
        if any(f"{stem[:k]}*" in chosen for k in range(min(PREFIXES), len(stem))):
            continue
        t, n = longer.get(r.feature, (0.0, 0))
        if n and (r.t - t < min_toxic or wilson(r.t - t, max(r.n - n, r.t - t)) <= min_precision):
            continue  # what is precise about this beginning is the longer feature
        chosen[r.feature] = (r.t, r.n)
        for k in range(min(PREFIXES), len(stem)):
            longer[f"{stem[:k]}*"] = max(longer.get(f"{stem[:k]}*", (0.0, 0)), (r.t, r.n))
    return sorted(chosen, key=lambda f: (-chosen[f][0], f))


def surely(t: Column, n: Column, z: float = 2.0) -> Column:
    """Lower Wilson bound of the share t / n."""
    p = t / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def wilson(t: float, n: float, z: float = 2.0) -> float:
    p = t / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def training_sample(docs: DataFrame, labels: DataFrame, text: str, id: str, label: str, max_labelled: int, folds: int) -> DataFrame:
    """``text, toxic``: distinct texts of labelled rows outside the held-out fold.

    At most about ``max_labelled`` ids, chosen by a hash of the id. An id that repeats gives one row,
    and equal texts give one row with the label of most of their ids (toxic if as many). Of near
    copies, known by the least hash of their five-word shingles, each label keeps one: words
    that only such a family shares would look like words of toxic texts.
    """

    @F.pandas_udf("long")
    def family(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, int] = {}
        for texts in batches:
            found = [shingles(t, 5, memo) for t in texts]
            yield pd.Series([int(h[0] >> np.uint64(1)) if len(h) else 0 for h in found], dtype="int64")

    usable = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull() & ~held_out(id, folds))
    usable = usable.groupBy(F.col(id).alias("doc_id")).agg(F.max(label).cast("int").alias("toxic"))
    n = usable.count()
    share = min(1.0, max_labelled / n) if n else 1.0
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    # Ids are bounded by max_labelled, rows are not.
    found = texts.join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    most = (F.avg("toxic") >= 0.5).cast("int").alias("toxic")
    distinct = one.groupBy(F.xxhash64("text").alias("row")).agg(F.any_value("text").alias("text"), most)
    return distinct.groupBy(family("text").alias("family"), "toxic").agg(F.min_by("text", "row").alias("text")).select("text", "toxic")


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    label: str = "toxic",
    max_labelled: int = 24_000,
    folds: int = 5,
) -> ToxicityModel:
    """Learn voters, the label model and the classifier from a bounded sample of labelled rows outside the held-out fold.

    1. Voters are lexicons, patterns, and words or beginnings of words induced from the
       labelled texts of the sample (see ``mine_features``).
    2. The label model (see ``LabelModel``) is fitted on the votes of all sampled texts, none of which
       sees its own label, and gives each a posterior.
    3. With the posteriors as labels, text features are mined again over all sampled texts; a
       ridge logistic regression on these, on the words of the lexicons and on the patterns
       learns the posteriors.

    The driver gets the mined features and, per sampled text, the numbers of what fired.
    """
    small_batches(docs.sparkSession, FEW_ROWS)
    sample = materialize(training_sample(docs, labels, text, id, label, max_labelled, folds))
    mined = mine_features(sample)
    wanted, n_words = voter_numbers(mined)
    width = n_words + len(PATTERNS) + 1  # the last voter fires where no other does

    def gathered(texts: DataFrame, wanted: dict[str, tuple[int, ...]], n_words: int) -> list[tuple]:
        """(label or posterior, what fired) of all sampled texts; sorted, equal ones counted."""

        heads = heads_of(wanted)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            memo: dict = {}
            for b in batches:
                yield pd.DataFrame({"toxic": b["toxic"], "fired": [fired_of(t, memo, wanted, n_words, heads) for t in b["text"]]})

        found = texts.select("text", F.col("toxic").cast("double").alias("toxic")).mapInPandas(run, "toxic double, fired array<int>")
        return sorted(Counter((r.toxic, tuple(r.fired)) for r in found.collect()).items())

    rows = gathered(sample, wanted, n_words)
    if {toxic for (toxic, _), _ in rows} != {0, 1}:
        # Nothing to learn from: the lexicons and patterns decide.
        columns, n = text_columns([])
        return ToxicityModel(columns, n, np.array([4.0] * (n + len(PATTERNS)) + [-3.0]))
    votes = Rows.of([f or (width - 1,) for (_, f), _ in rows], width, [n for _, n in rows])
    model = LabelModel()
    model.fit(votes, np.array([toxic for (toxic, _), _ in rows]))

    heads = heads_of(wanted)

    @F.pandas_udf("double")
    def posteriors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict = {}
        for texts in batches:
            fired = [fired_of(t, memo, wanted, n_words, heads) or [width - 1] for t in texts]
            yield pd.Series(model.posterior(Rows.of(fired, width)), dtype="float64")

    soft = materialize(sample.select("text", posteriors("text").alias("toxic")))
    columns, n = text_columns(dict.fromkeys([*mined, *mine_features(soft)]))
    rows = gathered(soft, columns, n)
    x = Rows.of([f for (_, f), _ in rows], n + len(PATTERNS), [k for _, k in rows])
    return ToxicityModel(columns, n, fit_linear(x, np.array([y for (y, _), _ in rows])), model)


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, text: str = "text", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """The ``keep`` columns, ``score`` (0 to 1) and ``predicted`` (1 from 0.5). No shuffle.

    A null or empty text is one where nothing fires. Repeated rows get equal scores.
    """
    score, columns, n_words, heads = replace(model, labels=None).score, model.columns, model.n_words, heads_of(model.columns)

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict = {}
        for texts in batches:
            yield pd.Series([score(fired_of(t, memo, columns, n_words, heads)) for t in texts], dtype="float64")

    scored = docs.select(*keep, rate(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", **options
) -> DataFrame:
    """Fit on labelled rows, score every row: ``doc_id, held_out, score, predicted``.

    Labels of the held-out fold, languages, sources and ids are no inputs. Repeated rows get
    equal scores; null ids are kept; labels of unknown documents, null labels and repeated
    labels (the greater counts) do no harm. Without labels of both kinds, fixed lexicons
    and patterns decide. An empty table gives an empty result.
    """
    model = fit_toxicity(docs, labels, text, id, label, **options)
    own = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    out = score_toxicity(own, model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
