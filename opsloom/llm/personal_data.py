"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans."""
from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chosen, in_arrow, slices

KINDS = ("email", "ip", "card", "phone")

# ---- fixed patterns

LOCAL = re.compile("[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NO_DIGIT = re.compile("[^0-9]+")
SIGN = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` with the longest run of local characters before it and a domain after it.

    The same matches as of the whole pattern from the left, but a long run without ``@`` is looked at once.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1, start):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of the four patterns by kind and start; a match that fails its test is dropped and not retried."""
    if not SIGN.search(text):
        return []
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = NO_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NO_DIGIT.sub("", m[0])) <= 15]
    return out


# ---- the field

#: Stretches that can hold entities: runs of digit groups, and words around a written-out or plain at sign.
NUMBERS = re.compile(r"[+(]{0,2}[0-9](?:[0-9+().\[\] -]*[0-9])?")
NUMBER = re.compile(r"[+(]{0,2}[0-9]+")
AT = r"(?: ?(?:@|[\[(](?:at|dot)[\])]) ?)"
MAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:{AT}[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)+")
MAIL_PART = re.compile(r"[A-Za-z0-9._%+-]+(?=$| ?[@\[(])")
GROUP = re.compile("[0-9]+")
#: Atoms in an entity at most: the bound of the dynamic programme.
MOST_ATOMS = 8
LEAST_DIGITS = 4


def islands(text: str) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Start, end and atoms of the stretches outside which no segment is a candidate."""
    if "@" in text or "(at)" in text or "[at]" in text:
        for m in MAIL.finditer(text):
            yield m.start(), m.end(), [(m.start() + a, m.start() + b) for a, b in (p.span() for p in MAIL_PART.finditer(m[0]))]
    for m in NUMBERS.finditer(text):
        if m.end() - m.start() >= LEAST_DIGITS and len(NO_DIGIT.sub("", m[0])) >= LEAST_DIGITS:
            yield m.start(), m.end(), [(m.start() + a, m.start() + b) for a, b in (p.span() for p in NUMBER.finditer(m[0]))]


def char_class(c: str) -> str:
    return "none" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "blank" if c.isspace() else c


def features(span: str, before: str, after: str) -> list[str]:
    """Features of a whole candidate span and of the characters beside it."""
    groups = GROUP.findall(span)
    digits = "".join(groups)
    gaps = GROUP.split(span)[1:-1]
    n = len(digits)
    out = ["1", f"before:{char_class(before)}", f"after:{char_class(after)}", f"digits:{min(n, 20)}", f"groups:{min(len(groups), 9)}",
           f"first:{char_class(span[0])}", f"gaps:{''.join(sorted(set(''.join(gaps))))[:6]}", f"lengths:{'-'.join(str(min(len(g), 9)) for g in groups[:6])}"]
    if 13 <= n <= 19:
        out.append(f"luhn:{luhn(digits)}")
    if len(groups) == 4:
        out.append(f"octets:{all(len(g) < 4 and int(g) <= 255 for g in groups)}:{gaps[0].strip('[] ') if len(set(gaps)) == 1 else 'mixed'}")
    parts = re.split(AT, span)
    if len(parts) > 1:
        first = re.search(AT, span)[0].strip(" ()[]")
        end = re.split(r"\.", parts[-1])[-1]
        dotted = "." in "".join(parts[1:]).strip(".") or "dot" in span[len(parts[0]):]
        out.append(f"mail:{first in ('@', 'at')}:{dotted}:{1 < len(end) < 7 and end.isalpha()}")
    else:
        out.append("letters" if re.search("[A-Za-z]", span) else "plain")
    return out


class Field:
    """Weights by feature, one per kind; text outside of entities scores 0."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None) -> None:
        self.weights = weights or {}

    def segments(self, text: str, atoms: list[tuple[int, int]], offset: int = 0, taken=lambda a, b: False) -> list[tuple[int, int, list[str]]]:
        """First atom, atom past the last, features of every candidate of up to ``MOST_ATOMS`` atoms that touches nothing ``taken``."""
        out = []
        for i in range(len(atoms)):
            for j in range(i + 1, min(len(atoms), i + MOST_ATOMS) + 1):
                if taken(atoms[i][0], atoms[j - 1][1]):
                    break  # every longer one touches it too
                a, b = atoms[i][0] - offset, atoms[j - 1][1] - offset
                out.append((i, j, features(text[a:b], text[a - 1:a] if a else "", text[b:b + 1])))
        return out

    def score(self, names: list[str]) -> np.ndarray:
        zero = np.zeros(len(KINDS))
        return sum((self.weights.get(f, zero) for f in names), zero)

    def best(self, text: str, atoms: list[tuple[int, int]], taken) -> list[tuple[str, int, int]]:
        """Boundaries and kinds of the best segmentation, jointly; segments that are ``taken(start, end)`` are no candidates."""
        ends = defaultdict(list)
        for i, j, names in self.segments(text, atoms, taken=taken):
            scores = self.score(names)
            kind = int(scores.argmax())
            if scores[kind] > 0:
                ends[j].append((i, float(scores[kind]), kind))
        if not ends:
            return []
        top, back = [0.0] * (len(atoms) + 1), [None] * (len(atoms) + 1)
        for j in range(1, len(atoms) + 1):
            top[j] = top[j - 1]
            for i, s, kind in ends[j]:
                if top[i] + s > top[j]:
                    top[j], back[j] = top[i] + s, (i, kind)
        out, j = [], len(atoms)
        while j:
            if back[j]:
                i, kind = back[j]
                out.append((KINDS[kind], atoms[i][0], atoms[j - 1][1]))
                j = i
            else:
                j -= 1
        return out[::-1]

    def learn(self, examples: list[tuple[str, list[tuple[int, int]], int, list[tuple[str, int, int]]]], rounds: int = 6, rate: float = 0.3, shrink: float = 1e-4) -> Field:
        """Stochastic ascent of the conditional likelihood of the true segmentation of each island.

        Forward and backward sums over all segmentations give the expected count of each candidate.
        """
        prepared = []
        for text, atoms, offset, truth in examples:
            true = {(a, b): KINDS.index(kind) for kind, a, b in truth}
            cands = self.segments(text, atoms, offset)
            prepared.append((len(atoms), [(i, j, names, true.get((atoms[i][0] - offset, atoms[j - 1][1] - offset), -1)) for i, j, names in cands]))
        weights = defaultdict(lambda: np.zeros(len(KINDS)), self.weights)
        order = np.random.default_rng(3)
        for r in range(rounds):
            step = rate / (1 + r)
            for at in order.permutation(len(prepared)):
                n, cands = prepared[at]
                scores = [sum(weights[f] for f in names) for _, _, names, _ in cands]
                forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
                forward[0] = backward[n] = 0.0
                by_end, by_start = defaultdict(list), defaultdict(list)
                for (i, j, _, _), s in zip(cands, scores, strict=True):
                    total = np.logaddexp.reduce(s)
                    by_end[j].append((i, total))
                    by_start[i].append((j, total))
                for j in range(1, n + 1):
                    forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[i] + s for i, s in by_end[j])])
                for i in range(n - 1, -1, -1):
                    backward[i] = np.logaddexp.reduce([backward[i + 1], *(backward[j] + s for j, s in by_start[i])])
                for (i, j, names, kind), s in zip(cands, scores, strict=True):
                    change = -np.exp(forward[i] + s + backward[j] - forward[n])
                    if kind >= 0:
                        change[kind] += 1
                    if np.abs(change).max() > 1e-3:
                        for f in names:
                            weights[f] = weights[f] * (1 - shrink) + step * change
        return Field(dict(weights))


def rewritten(text: str, kind: str, random: np.random.Generator) -> tuple[str, bool]:
    """The span written another way (still of its kind), or spoilt (of no kind any more)."""
    if kind == "email":
        name, _, domain = text.partition("@")
        return (f"{name} (at) {domain.replace('.', ' (dot) ')}", True) if random.random() < 0.5 else (f"{name}[at]{domain}", True)
    if kind == "ip":
        if random.random() < 0.5:
            return text.replace(".", "[.]"), True
        parts = text.split(".")
        parts[int(random.integers(4))] = str(random.integers(256, 999))
        return ".".join(parts), False
    if kind == "card":
        digits = NO_DIGIT.sub("", text)
        if random.random() < 0.5:
            return ".".join(digits[i:i + 4] for i in range(0, len(digits), 4)), True
        at = int(random.integers(len(digits)))
        return digits[:at] + str((int(digits[at]) + int(random.integers(1, 9))) % 10) + digits[at + 1:], False
    if random.random() < 0.5 and "(" in text:
        return text.lstrip("+"), True
    return NO_DIGIT.sub("", text)[:int(random.integers(4, 9))], False


def examples_of(text: str, most: int) -> list[tuple[str, int, int, list[tuple[str, int, int]]]]:
    """Up to ``most`` islands of a text with a little of it on both sides, and the fixed matches inside."""
    base, out = base_spans(text), []
    for start, end, _ in islands(text):
        a, b = max(0, start - 3), end + 3
        if b - a < 400:
            out.append((text[a:b], start - a, end - a, [(k, s - a, e - a) for k, s, e in base if start <= s and e <= end]))
        if len(out) == most:
            break
    return out


def train(docs: DataFrame, text: str = "text", doc: str = "doc_id", sample_docs: int = 3_000, per_doc: int = 8) -> Field:
    """A field from islands of about ``sample_docs`` documents (those with the smallest hashes), ``per_doc`` of each at most.

    The fixed matches are the truth, everything else is not an entity. Each match is also given once in another
    writing, or spoilt, in the same surroundings, so that the field learns what makes a kind beyond the patterns.
    """
    some = docs.filter(chosen(F.xxhash64(F.col(doc), F.lit(17)), sample_docs / max(docs.count(), 1))).select(F.col(text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for body in batch.column(0).to_pylist() if body for x in examples_of(body, per_doc)]
            yield pa.record_batch([pa.array([x[0] for x in found], pa.string()), pa.array(["\n".join(f"{k} {a} {b}" for k, a, b in x[3]) for x in found], pa.string())], ["part", "truth"])

    random, examples = np.random.default_rng(9), []

    def take(part: str, truth: list[tuple[str, int, int]]) -> None:
        for start, end, atoms in islands(part):
            inside, done = [], start
            for k, a, b in sorted(truth, key=lambda t: t[1]):
                if done <= a and b <= end:
                    inside.append((k, a, b))
                    done = b
            examples.append((part, atoms, 0, inside))

    for row in sorted(tuple(r) for r in in_arrow(some, run, "part string, truth string").toLocalIterator()):
        truth = [(k, int(a), int(b)) for k, a, b in (x.split() for x in row[1].split("\n") if x)]
        take(row[0], truth)
        for k, a, b in truth:
            other, still = rewritten(row[0][a:b], k, random)
            take(row[0][:a] + other + row[0][b:], [(k, a, a + len(other))] if still else [])
    return Field().learn(examples)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


class Taken:
    """Spans in order of start, with how far those up to each reach: whether one of them is touched is one bisection."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()) -> None:
        self.starts: list[int] = []
        self.reach: list[int] = []
        for a, b in sorted(spans):
            self.add(a, b)

    def add(self, a: int, b: int) -> None:
        """One more, not before those that are there."""
        self.starts.append(a)
        self.reach.append(max(b, self.reach[-1]) if self.reach else b)

    def touches(self, a: int, b: int) -> bool:
        at = bisect_left(self.starts, b) - 1
        return at >= 0 and self.reach[at] > a


def all_spans(text: str, field: Field) -> list[tuple[str, int, int, bool]]:
    """Fixed matches and the spans that the field adds beside them, by kind and start. The work is in proportion to the text."""
    base = base_spans(text)
    fixed, mails = Taken((a, b) for _, a, b in base), Taken()
    out = [(*s, True) for s in base]
    for _, _, atoms in islands(text):
        found = field.best(text, atoms, lambda a, b: fixed.touches(a, b) or mails.touches(a, b))
        for kind, a, b in found:
            # Stretches of digits, which come after those of mails, do not overlap each other.
            if kind == "email" and (not mails.starts or a >= mails.starts[-1]):
                mails.add(a, b)
        out += [(*s, False) for s in found]
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find(docs: DataFrame, field: Field, text: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with the personal data of every whole text: ``kind, start, end`` (code points, end exclusive) and ``base``.

    ``base`` spans are the matches of the fixed patterns, kind by kind; they always stay. Other spans are
    those of the field, which do not overlap them. Null counts as empty; it has no spans. A given column of
    that name is refused. Rows are judged one by one.
    """
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"documents already have {name}")
    sent = docs.sparkSession.sparkContext.broadcast(field.weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(sent.value)
        for batch in slices(batches, text):
            found = [all_spans(x, own) if x else [] for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            spans = pa.array([[{"kind": k, "start": a, "end": b, "base": f} for k, a, b, f in spans] for spans in found], ARROW_SPAN)
            yield pa.record_batch([*batch.columns, spans], [*batch.schema.names, name])

    return in_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(SPAN))]))
