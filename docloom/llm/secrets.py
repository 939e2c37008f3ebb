"""Secret scans: fixed patterns, and automata inferred from the credentials that these label.

The patterns (assignments, access keys, hex strings) give the base findings of every
text, and at the same time labelled credentials. Of each kind a bounded sample
(`sample` distinct values of least hash, of at most `longest` characters) trains a probabilistic automaton: a prefix
tree whose states are merged, from the root on, where the lengths to go, the next symbols and the next characters
of their continuations, and so on below, differ by no more than a Hoeffding bound allows. Letters and digits are
one symbol of a credential's tree and each separator another, so a state stands for a place in
the format: a fixed length, a separator or a literal prefix keeps its states apart, free text becomes a loop. An
equal sample of ordinary tokens, out of all texts, trains the contrast, with letters of either case and digits as symbols.

Every candidate of every text (a run of `A-Za-z0-9+/_.=-` of 6 or more characters, full stops at its
end taken off) is scored by each kind's automaton: the log-likelihood of the unlikeliest step of its format (a symbol or the end), and the whole
token's log-likelihood by characters less that by the contrast. A candidate that overlaps no base finding of any kind and exceeds both of a kind's
thresholds becomes a span of the kind whose second it exceeds most, of the kind listed first where two are equal. Thresholds are what all
but `miss` of the kind's values exceed when the other half of them trains. Where more than `false` of the ordinary tokens exceed these and as many come
near (no gap lies between, as for credentials like words), the second is raised to what all but `false` of them reach; behind a gap they are taken for unlabelled credentials.

Defined cases: null text counts as empty; a text is scanned whole, however long; repeated rows each get a row; an empty table gives no rows; without
any labelled credential no spans are added; null ids stay; base findings of two kinds may overlap and all count; other columns are ignored (findings) or
kept (redacted), whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import give_back

KINDS = ("assign", "access", "hex")
# The base patterns and the lengths below which their matches are dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
PLACE = np.full(128, len(SIGNS), dtype=np.int64)
PLACE[[ord(c) for c in SIGNS]] = np.arange(len(SIGNS))
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the pattern findings, by start, then kind as listed."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    if _DIGIT.search(text) or len(text) >= 24:
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def credential(text: str, span: Span) -> str:
    """The credential itself: an assignment's value, else the whole span."""
    a, b, kind = span
    return ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]


def candidates(text: str) -> set[str]:
    return {t for t in {m.rstrip(".") for m in CANDIDATE.findall(text)} if len(t) >= 6}


def format_symbol(c: str) -> str:
    return "w" if c.isalnum() else c


def word_symbol(c: str) -> str:
    return "d" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c


@dataclass
class State:
    """next: symbol to state; seen: passes by symbol; chars: passes by character; togo: passes by characters that follow."""

    next: dict[str, int] = field(default_factory=dict)
    seen: Counter = field(default_factory=Counter)
    chars: Counter = field(default_factory=Counter)
    togo: Counter = field(default_factory=Counter)
    total: int = 0

    @property
    def ends(self) -> int:
        return self.total - sum(self.seen.values())


def furthest(a: Counter, n: int, b: Counter, m: int) -> float:
    """Largest difference of two frequencies."""
    return max((abs(a[c] / n - b[c] / m) for c in a.keys() | b.keys()), default=0.0)


def cdf_gap(a: Counter, n: int, b: Counter, m: int) -> float:
    """Largest difference of two distributions, summed up from the least value."""
    most = left = right = 0.0
    for x in sorted(a.keys() | b.keys()):
        left, right = left + a[x] / n, right + b[x] / m
        most = max(most, abs(left - right))
    return most


def alike(states: list[State], a: int, b: int, alpha: float) -> bool:
    """Whether all continuations of a and b, as far as both have them, agree within the bound."""
    stack = [(a, b)]
    while stack:
        x, y = (states[i] for i in stack.pop())
        n, m = x.total, y.total
        bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        if bound >= 1:  # too few to tell apart, and below them there are fewer
            continue
        if cdf_gap(x.togo, n, y.togo, m) > bound or furthest(x.seen, n, y.seen, m) > bound or furthest(x.chars, n, y.chars, m) > bound:
            return False
        stack += [(x.next[c], y.next[c]) for c in x.next if c in y.next]
    return True


def fold(states: list[State], into: int, tree: int) -> None:
    """Adds the counts of the tree below state `tree` to those from state `into` on."""
    stack = [(into, tree)]
    while stack:
        x, y = (states[i] for i in stack.pop())
        x.total += y.total
        x.seen.update(y.seen)
        x.chars.update(y.chars)
        x.togo.update(y.togo)
        for c, below in y.next.items():
            if c in x.next:
                stack.append((x.next[c], below))
            else:
                x.next[c] = below


def infer(values: Iterable[str], symbol: Callable[[str], str] = format_symbol, alpha: float = 0.05) -> list[State]:
    """The values' prefix tree with its statistically compatible states merged; the first state is the start."""
    states = [State()]
    for v in sorted(values):
        at = 0
        for i, c in enumerate(v):
            s, here = symbol(c), states[at]
            here.total += 1
            here.seen[s] += 1
            here.chars[c] += 1
            here.togo[len(v) - i] += 1
            if s not in here.next:
                here.next[s] = len(states)
                states.append(State())
            at = here.next[s]
        states[at].total += 1
        states[at].togo[0] += 1
    kept = [0]
    while edge := [(states[s].seen[c], s, c) for s in kept for c in states[s].next if states[s].next[c] not in kept]:
        _, s, c = max(edge, key=lambda e: (e[0], -e[1], e[2]))
        new = states[s].next[c]
        old = next((k for k in kept if alike(states, k, new, alpha)), None)
        if old is None:
            kept.append(new)
        else:
            states[s].next[c] = old
            fold(states, old, new)
    number = {s: i for i, s in enumerate(kept)}
    return [State({c: number[t] for c, t in states[s].next.items()}, states[s].seen, states[s].chars, states[s].togo, states[s].total) for s in kept]


@dataclass
class Automaton:
    """An inferred automaton as tables: next state by (state, character), log-probability of the character and of its symbol by the
    same, and of ending in a state, by the character counts and by the symbol counts."""

    step: np.ndarray
    log: np.ndarray
    format: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, states: list[State], symbol: Callable[[str], str], weight: float = 2.0) -> Automaton:
        """Counts are smoothed towards the whole automaton's: symbols and ends with `weight` counts in each state, characters with as many
        as there are different ones. A character without a step leads to the start."""
        chars, symbols = sum((s.chars for s in states), Counter()), sum((s.seen for s in states), Counter())
        ends = sum(s.ends for s in states)
        whole = sum(chars.values()) + ends
        share = lambda n: (n + 0.02) / (whole + 0.02 * (len(SIGNS) + 1))
        mine = [symbol(c) for c in SIGNS]
        step = np.zeros((len(states), len(SIGNS)), dtype=np.int32)
        log, form, end = np.empty((len(states), len(SIGNS))), np.empty((len(states), len(SIGNS))), np.empty(len(states))
        for i, s in enumerate(states):
            step[i] = [s.next.get(x, 0) for x in mine]
            log[i] = [math.log((s.chars[c] + len(chars) * share(chars[c])) / (s.total + len(chars))) for c in SIGNS]
            form[i] = [math.log((s.seen[x] + weight * share(symbols[x])) / (s.total + weight)) for x in mine]
            end[i] = math.log((s.ends + weight * share(ends)) / (s.total + weight))
        return cls(step, log, form, end)

    def score(self, signs: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods, and those of the unlikeliest step, of tokens given as places in SIGNS, from starts on, longest first; all
        tokens go ahead character by character."""
        state, out, worst = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts)), np.zeros(len(starts))
        flat_step, flat_log, flat_form, wide = self.step.ravel(), self.log.ravel(), self.format.ravel(), len(SIGNS)
        counts = np.searchsorted(-lengths, -np.arange(lengths[0]) - 1, side="right") if len(lengths) else []
        for i, n in enumerate(counts):
            at = state[:n] * wide + signs[starts[:n] + i]
            out[:n] += flat_log[at]
            np.minimum(worst[:n], flat_form[at], out=worst[:n])
            state[:n] = flat_step[at]
        return out + self.end[state], np.minimum(worst, self.end[state])


def laid_out(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    tokens = sorted(tokens, key=lambda t: (-len(t), t))
    lengths = np.array([len(t) for t in tokens], dtype=np.int64)
    signs = PLACE[np.frombuffer("".join(tokens).encode("ascii"), dtype=np.uint8)]
    return signs, np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64), lengths, tokens


@dataclass
class SecretModel:
    automata: dict[str, Automaton]
    contrast: Automaton | None
    least: dict[str, tuple[float, float]]

    def scores(self, tokens: Iterable[str]) -> tuple[list[str], dict[str, np.ndarray]]:
        """Of each kind: two rows, the unlikeliest step's log-likelihood and the margin over the contrast."""
        *places, tokens = laid_out(list(tokens))
        if not tokens:
            return tokens, {k: np.zeros((2, 0)) for k in self.automata}
        plain = self.contrast.score(*places)[0]
        own = {k: a.score(*places) for k, a in self.automata.items()}
        return tokens, {k: np.stack([worst, x - plain]) for k, (x, worst) in own.items()}

    def secrets(self, tokens: Iterable[str]) -> dict[str, str]:
        """Tokens that a kind's automaton tells to be credentials, with the kind."""
        if not self.automata:
            return {}
        tokens, scores = self.scores(tokens)
        kinds = [k for k in KINDS if k in scores]
        above = np.array([np.where(scores[k][0] >= self.least[k][0], scores[k][1] - self.least[k][1], -np.inf) for k in kinds])
        best = above.argmax(axis=0)
        return {tokens[i]: kinds[best[i]] for i in np.flatnonzero(above.max(axis=0) > 0)} if tokens else {}

    def scanned(self, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
        """Base spans and added spans of each text."""
        own = [candidates(t or "") for t in texts]
        known = self.secrets(set().union(*own))
        out = []
        for text, mine in zip(texts, own, strict=True):
            base = base_spans(text or "")
            extra = []
            if known and not known.keys().isdisjoint(mine):
                for m in CANDIDATE.finditer(text):
                    token = m[0].rstrip(".")
                    a, b = m.start(), m.start() + len(token)
                    if token in known and not any(x < b and a < y for x, y, _ in base):
                        extra.append((a, b, known[token]))
            out.append((base, extra))
        return out


def labelled(docs: DataFrame, text_col: str, sample: int, longest: int) -> dict[str, list[str]]:
    """Distinct credentials of each kind, and ordinary candidates under "": at most `sample` of each, those of least hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        least: dict[str, dict[int, str]] = {k: {} for k in ("", *KINDS)}
        limit = dict.fromkeys(least, 1 << 64)

        def keep(kind: str, values: Iterable[str]) -> None:
            mine, below = least[kind], limit[kind]
            for v in values:
                h = xxhash.xxh64_intdigest(v, 7)
                if h < below and len(v) <= longest:
                    mine[h] = v
            if len(mine) > 4 * sample:
                order = sorted(mine)
                limit[kind] = order[sample - 1] + 1
                for h in order[sample:]:
                    del mine[h]

        for b in batches:
            ordinary: set[str] = set()
            for text in b.column(0).to_pylist():
                if not text:
                    continue
                spans = base_spans(text)
                if not spans:
                    ordinary |= candidates(text)
                    continue
                for kind in KINDS:
                    keep(kind, [credential(text, s) for s in spans if s[2] == kind])
                free = [m[0].rstrip(".") for m in CANDIDATE.finditer(text) if not any(a < m.end() and m.start() < z for a, z, _ in spans)]
                ordinary.update([t for t in free if len(t) >= 6])
            keep("", ordinary)
        rows = [(k, h - (1 << 63), v) for k, mine in least.items() for h, v in sorted(mine.items())[:sample]]
        if rows:
            kinds, hashes, values = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(hashes, pa.int64()), pa.array(values, pa.string())], ["kind", "hash", "value"])

    found = docs.select(text_col).mapInArrow(run, "kind string, hash long, value string").distinct().persist()
    out = {k: [r["value"] for r in found.where(F.col("kind") == k).orderBy("hash").limit(sample).collect()] for k in ("", *KINDS)}
    found.unpersist()
    return {k: v for k, v in out.items() if v}


def fit(docs: DataFrame, text_col: str = "text", sample: int = 1500, longest: int = 256, miss: float = 0.02, false: float = 0.001) -> SecretModel:
    values = labelled(docs, text_col, sample, longest)
    ordinary = values.pop("", [])
    if not values:
        return SecretModel({}, None, {})
    contrast = Automaton.of(infer(ordinary, word_symbol), word_symbol)
    of = lambda v: Automaton.of(infer(v), format_symbol)
    model = SecretModel({k: of(v) for k, v in values.items()}, contrast, {})
    plain = model.scores(ordinary)[1]
    for kind, mine in values.items():
        mine = sorted(mine)
        halves = ((mine[::2], mine[1::2]), (mine[1::2], mine[::2])) if len(mine) > 1 else ((mine, mine),)
        unseen = np.concatenate([SecretModel({kind: of(train)}, contrast, {}).scores(test)[1][kind] for train, test in halves], axis=1)
        typical, margin = np.sort(unseen)[:, int(miss * unseen.shape[1])].tolist()
        least = max(0.0, margin)
        ordinary_margins = np.sort(plain[kind][1][plain[kind][0] >= typical])
        above, near = int((ordinary_margins >= least).sum()), int(((ordinary_margins >= least / 2) & (ordinary_margins < least)).sum())
        if above > false * len(ordinary) and near >= above:
            least = float(ordinary_margins[-1 - int(false * len(ordinary))])
        model.least[kind] = (typical, least)
    return model


def findings(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of base findings, their digest, and all spans."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for base, extra in model.scanned(b.column(1).to_pylist()):
                n = Counter(k for _, _, k in base)
                spans = sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))
                out.append((*[n[k] for k in KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = zip(*out, strict=True) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return findings(docs, fit(docs, text_col), id_col, text_col)


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[REDACTED]") -> DataFrame:
    """docs with each found span replaced by a mark, in all columns as before; length_col gets the new length."""
    model = fit(docs, text_col)
    names, at = docs.columns, docs.columns.index(text_col)
    length_at = names.index(length_col) if length_col in names else None

    def cleaned(text: str | None, spans: list[Span]) -> str | None:
        out, end = [], 0
        for a, b, _ in sorted(spans):
            if b > end:
                if a >= end:
                    out += [text[end:a], mark]
                end = b
        return "".join([*out, text[end:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            before = b.column(at).to_pylist()
            texts = [cleaned(t, base + extra) for t, (base, extra) in zip(before, model.scanned(before), strict=True)]
            cols[at] = pa.array(texts, cols[at].type)
            if length_at is not None:
                old = cols[length_at].to_pylist()
                cols[length_at] = pa.array([n if t == was else len(t) for n, t, was in zip(old, texts, before, strict=True)], cols[length_at].type)
            yield pa.RecordBatch.from_arrays(cols, names)
        give_back()

    return docs.mapInArrow(run, docs.schema)
