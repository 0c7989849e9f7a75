"""Operator 7: secret scans by grammar inference.

Labelled credentials of a kind are read as strings of character classes (their
first letters as themselves), laid into a prefix tree, and states whose
continuations do not differ significantly (Hoeffding bound) are merged, breadth
first, into a probabilistic automaton. Every candidate token of a text, and
every part of one that begins and ends at separators, is scored by the
likelihood of its format under each automaton against that under an automaton
of ordinary strings; of overlapping parts that beat the threshold the best
gives a span. Spans of fixed patterns come besides.
"""

from __future__ import annotations

import math
import random
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns and least lengths of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
BASE_KINDS = ("assign", "access", "hex")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{16,}={0,2}")
#: Characters of a candidate beside which a credential may begin or end, and the least length of one.
SEPARATORS = frozenset("+/_.-")
LEAST_LENGTH = 16
#: Letters at the front of a token that are read as themselves.
LITERAL = 3
#: Significance of the merge test, and labelled strings made of each format.
ALPHA = 0.05
SAMPLES = 120
#: Log-likelihood ratio against ordinary strings from which a candidate is a credential: between labelled ones (-3 and more) and ordinary ones (-13 and less).
LEAST_RATIO = -4.0
#: Probabilities of a class, and of a leading character, that a state never saw.
_UNSEEN, _UNSEEN_LITERAL = 2e-3, 1e-6
#: An ordinary string is at least as likely as one of characters drawn from so many.
_ALPHABET = 64

# Public credential formats as (kind, parts); a part is a literal or (alphabet, least, most).
_BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
FORMATS = (
    ("github", (("ghp_", "gho_", "ghs_"), (_BASE62, 36, 36))),
    ("gitlab", (("glpat-",), (_BASE62 + "_-", 20, 20))),
    ("slack", (("xoxb-", "xoxp-"), ("0123456789", 10, 13), ("-",), ("0123456789", 10, 13), ("-",), (_BASE62, 24, 24))),
    ("stripe", (("sk_live_", "rk_live_"), (_BASE62, 24, 32))),
    ("google", (("AIza",), (_BASE62 + "_-", 35, 35))),
    ("npm", (("npm_",), (_BASE62, 36, 36))),
    ("sendgrid", (("SG.",), (_BASE62 + "_-", 22, 22), (".",), (_BASE62 + "_-", 43, 43))),
    ("jwt", (("eyJ",), (_BASE62, 17, 40), (".eyJ",), (_BASE62 + "_-", 20, 80), (".",), (_BASE62 + "_-", 43, 43))),
)
# Ordinary long tokens, as formats of the same form.
_LOWER = "abcdefghijklmnopqrstuvwxyz"
ORDINARY = (
    ((_LOWER, 16, 30),),
    ((_LOWER, 3, 9), ("_", "-", ".", "/"), (_LOWER, 3, 9), ("_", "-", ".", "/"), (_LOWER, 4, 12)),
    (("http", "www.", "doc_", "src/", "lib/"), (_LOWER, 4, 9), (".", "/"), (_LOWER, 3, 9), ("/", "_"), (_LOWER, 3, 9), ("/", "."), ("0123456789", 1, 4)),
    (("0123456789", 16, 20),),
    (("0123456789", 4, 4), ("-",), ("0123456789", 4, 4), ("-",), ("0123456789", 4, 4), ("-",), ("0123456789", 4, 4)),
    (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1, 1), (_LOWER, 5, 9), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1, 1), (_LOWER, 5, 9), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1, 1), (_LOWER, 5, 9)),
    (("-", "=", ".", "_"), ("-", "=", ".", "_"), ("-_.=", 14, 40)),
    ((_LOWER + "0123456789", 16, 40),),
)


def labelled_credentials(seed: int = 7, samples: int = SAMPLES) -> list[tuple[str, str]]:
    """The labelled table (token, kind): `samples` strings drawn from each public format, and of ordinary ones (kind '')."""
    rng = random.Random(seed)

    def draw(parts) -> str:
        return "".join("".join(rng.choices(p[0], k=rng.randint(p[1], p[2]))) if len(p) == 3 and isinstance(p[1], int) else rng.choice(p) for p in parts)

    return [(draw(parts), kind) for kind, parts in FORMATS for _ in range(samples)] + [(draw(parts), "") for parts in ORDINARY for _ in range(samples)]


def _classes() -> dict[str, str]:
    out = {c: "d" for c in "0123456789"}
    out |= {c: "l" for c in _LOWER} | {c: "U" for c in _LOWER.upper()}
    return out


_CLASS = _classes()
_END = "end"


def symbols(token: str, literal: int = LITERAL) -> list[str]:
    """A token as the automata read it: leading characters as themselves, then classes; punctuation always as itself."""
    return [f"={c}" for c in token[:literal]] + [_CLASS.get(c, c) for c in token[literal:]]


#: The log-likelihood of one character within its class.
_WITHIN = {"d": -math.log(10), "l": -math.log(26), "U": -math.log(26)}


class Automaton:
    """A probabilistic automaton learned by state merging."""

    def __init__(self, tokens: list[str], literal: int = LITERAL, alpha: float = ALPHA):
        self.literal = literal
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        for token in tokens:
            state = 0
            for s in symbols(token, literal):
                self.count[state][s] = self.count[state].get(s, 0) + 1
                if s not in self.next[state]:
                    self.next[state][s] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                state = self.next[state][s]
            self.count[state][_END] = self.count[state].get(_END, 0) + 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()
        self.log = [{s: math.log(n / sum(c.values())) for s, n in c.items()} for c in self.count]
        often: dict[str, tuple[int, int]] = {}
        for state in range(len(self.next)):
            for s, t in self.next[state].items():
                often[s] = max(often.get(s, (0, 0)), (self.count[state][s], t))
        self.back = {s: t for s, (_, t) in often.items()}
        #: Separators that tokens hold behind their leading characters.
        self.holds = {c for seen in self.count for c in seen if c in SEPARATORS}
        # What a symbol adds to the log-likelihood against characters drawn from _ALPHABET, by state.
        self.gain = [{s: p + _WITHIN.get(s, 0.0) + math.log(_ALPHABET) for s, p in log.items()} for log in self.log]

    def _differ(self, a: int, b: int) -> bool:
        """Whether some continuation of two states differs beyond the bound."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            ca, cb = self.count[a], self.count[b]
            na, nb = sum(ca.values()), sum(cb.values())
            if not na or not nb:
                continue
            limit = self.bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if any(abs(ca.get(s, 0) / na - cb.get(s, 0) / nb) > limit for s in {*ca, *cb}):
                return True
            todo += [(self.next[a][s], self.next[b][s]) for s in self.next[a] if s in self.next[b]]
        return False

    def _distance(self, a: int, b: int) -> float:
        """The total variation between what two states continue with; of compatible states the nearest is merged with."""
        ca, cb = self.count[a], self.count[b]
        na, nb = max(1, sum(ca.values())), max(1, sum(cb.values()))
        return sum(abs(ca.get(s, 0) / na - cb.get(s, 0) / nb) for s in {*ca, *cb})

    def _fold(self, red: int, blue: int) -> None:
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            for s, n in self.count[b].items():
                self.count[a][s] = self.count[a].get(s, 0) + n
            for s, t in self.next[b].items():
                if s in self.next[a]:
                    todo.append((self.next[a][s], t))
                else:
                    self.next[a][s] = t

    def _merge_states(self) -> None:
        red, queue, known = [0], deque((0, s) for s in sorted(self.next[0])), {0}
        while queue:
            parent, s = queue.popleft()
            blue = self.next[parent].get(s)
            if blue is None or blue in known:
                continue
            near = [(self._distance(r, blue), r) for r in red if not self._differ(r, blue)]
            if near:
                r = min(near)[1]
                self.next[parent][s] = r
                self._fold(r, blue)
                queue.extend((r, x) for x in sorted(self.next[r]) if self.next[r][x] not in known)
            else:
                red.append(blue)
                known.add(blue)
                queue.extend((blue, x) for x in sorted(self.next[blue]))

    def score(self, token: str) -> float:
        """The log-likelihood of a token; a symbol not seen in a state costs a fixed amount and leads where it leads most often."""
        state, total, unseen, strange = 0, 0.0, math.log(_UNSEEN), math.log(_UNSEEN_LITERAL)
        for s in symbols(token, self.literal):
            total += self.log[state].get(s, strange if len(s) > 1 else unseen) + _WITHIN.get(s, 0.0)
            state = self.next[state].get(s, self.back.get(s, state))
        return total + self.log[state].get(_END, unseen)


    def parts(self, token: str, classes: list[str], least: float) -> list[tuple[float, bool, int, int]]:
        """(ratio, known, start, end) of a token's parts between separators whose likelihood beats drawn characters by `least`.

        A part is known if its leading characters were all seen. No part goes
        over a separator that no labelled token holds. Parts that have come to
        one state go on alike: of those the likeliest is followed, and of known
        ones also earlier ones that beat drawn characters so far.
        """
        found: list[tuple[float, bool, int, int]] = []
        live: list[tuple[int, float, bool, int]] = []
        unseen, strange, size, n = math.log(_UNSEEN), math.log(_UNSEEN_LITERAL), math.log(_ALPHABET), len(token)
        gain, following, back, literal = self.gain, self.next, self.back, self.literal
        for i in range(n + 1):
            c = token[i] if i < n else ""
            cut = c in SEPARATORS
            if i == n or cut or c == "=":
                for state, ratio, known, start in live:
                    if i - start >= LEAST_LENGTH and (r := ratio + self.log[state].get(_END, unseen)) >= least:
                        found.append((r, known, start, i))
            if i == n:
                break
            if not i or cut or token[i - 1] in SEPARATORS:
                live.append((0, 0.0, True, i))
            own = classes[i]
            foreign = cut and own not in self.holds
            moved: list[tuple[int, float, bool, int]] = []
            best: dict[tuple[int, bool], float] = {}
            for state, ratio, known, start in live:
                first = i - start < literal
                s = f"={c}" if first else own
                g = gain[state].get(s)
                if g is None:
                    if foreign and not first:
                        continue
                    known = known and not first
                    g = (strange if first else unseen) + _WITHIN.get(s, 0.0) + size
                t = following[state].get(s)
                if t is None:
                    t = back.get(s, state)
                ratio += g
                if i - start >= LEAST_LENGTH:
                    top = best.get((t, known), -math.inf)
                    if known and ratio <= top:
                        continue
                    best[t, known] = max(top, ratio)
                moved.append((t, ratio, known, start))
            live = moved if len(moved) < 2 else [h for h in moved if i - h[3] < LEAST_LENGTH or (h[2] and h[1] >= least) or h[1] >= best[h[0], h[2]]]
        return found

    def prefixes(self, classes: list[str], ends: set[int]) -> dict[int, float]:
        """The log-likelihood of the prefixes of the given lengths, for an automaton that reads no literals."""
        state, total, unseen, out = 0, 0.0, math.log(_UNSEEN), {}
        for i, s in enumerate(classes):
            if i in ends:
                out[i] = total + self.log[state].get(_END, unseen)
            total += self.log[state].get(s, unseen) + _WITHIN.get(s, 0.0)
            state = self.next[state].get(s, self.back.get(s, state))
        return out | {len(classes): total + self.log[state].get(_END, unseen)}


def learn(labelled: list[tuple[str, str]]) -> dict[str, Automaton]:
    """An automaton for each kind of a small labelled table; '' is the kind of ordinary strings."""
    kinds: dict[str, list[str]] = {}
    for token, kind in labelled:
        kinds.setdefault(kind, []).append(token)
    return {kind: Automaton(tokens, LITERAL if kind else 0) for kind, tokens in sorted(kinds.items())}


def format_kind(token: str, automata: dict[str, Automaton], least: float = LEAST_RATIO) -> str | None:
    """The kind whose automaton makes `token` likeliest, if the log-likelihood beats that of ordinary strings by `least`."""
    ordinary = max(automata[""].score(token) if "" in automata else -math.inf, -len(token) * math.log(_ALPHABET))
    best, kind = max(((a.score(token), k) for k, a in automata.items() if k), default=(-math.inf, ""))
    return kind if best - ordinary >= least else None


def credentials(token: str, automata: dict[str, Automaton], least: float = LEAST_RATIO) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the credentials in a candidate token, none overlapping another.

    Parts with known leading characters come first, from left to right, each to
    its last possible end, so that no tail of a credential is left; then the
    token as a whole; then other parts, the likeliest first.
    """
    classes = [_CLASS.get(c, c) for c in token]
    likely = [(kind, *part) for kind, a in automata.items() if kind for part in a.parts(token, classes, least)]
    ends: dict[int, set[int]] = {}
    for _, _, _, start, end in likely:
        ends.setdefault(start, set()).add(end - start)
    ordinary = {start: automata[""].prefixes(classes[start : start + max(n)], n) for start, n in ends.items()} if "" in automata else {}
    scored: dict[tuple[bool, int, str], tuple[float, int]] = {}
    for kind, ratio, known, start, end in likely:
        value = ratio - max(0.0, ordinary[start][end - start] + (end - start) * math.log(_ALPHABET)) if ordinary else ratio
        if value >= least:
            top, last = scored.get((known, start, kind), (-math.inf, 0))
            scored[known, start, kind] = max(top, value), max(last, end)
    whole = token if token[-1] == "=" else token.rstrip("".join(SEPARATORS))
    order = sorted((start, -value, kind, end) for (known, start, kind), (value, end) in scored.items() if known)
    parts = [(kind, start, end) for start, _, kind, end in order]
    if len(whole) >= LEAST_LENGTH and (kind := format_kind(whole, automata, least)):
        parts.append((kind, 0, len(whole)))
    order = sorted((-value, start, kind, end) for (known, start, kind), (value, end) in scored.items() if not known)
    parts += [(kind, start, end) for _, start, kind, end in order]
    out: list[tuple[str, int, int]] = []
    for kind, start, end in parts:
        if all(end <= a or b <= start for _, a, b in out):
            out.append((kind, start, end))
    return out


def spans(text: str | None, automata: dict[str, Automaton]) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a whole text, by start and then kind, base kinds first; code points, end exclusive."""
    if not text:
        return []
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        found += [(kind, m.start() + a, m.start() + b) for kind, a, b in credentials(m[0], automata)]
    order = {k: i for i, k in enumerate(BASE_KINDS)}
    return sorted(found, key=lambda x: (x[1], order.get(x[0], len(order)), x[0]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _learner(labelled: list[tuple[str, str]] | None):
    """Automata learned once a worker from the labelled table that the closure carries."""
    table = labelled_credentials() if labelled is None else labelled
    cache: list[dict[str, Automaton]] = []

    def get() -> dict[str, Automaton]:
        if not cache:
            cache.append(learn(table))
        return cache[0]

    return get


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: list[tuple[str, str]] | None = None) -> DataFrame:
    """(id_col, spans) for each row of `docs`; spans is an array of (kind, start, end) over the whole text.

    Defined cases: a null or empty text has no spans; an id is passed through,
    null or repeated; equal spans of different kinds are all kept; a text of any
    length is scanned whole, and its task holds it; an empty table gives no
    rows; other columns are not looked at.
    """
    automata = _learner(labelled)
    source = docs.select(F.col(id_col), F.col(text_col).alias("text"))

    def run(batches):
        known = automata()
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t.as_py(), known)] for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, _SPANS)], [id_col, "spans"])

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def joined(spans: Column) -> Column:
    """An array of spans as `kind:start:end`, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, found: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """`text` with each stretch covered by spans replaced by `mark`."""
    out, at, end = [], 0, -1
    for _, a, b in found:
        if a >= end:
            out += [text[at:a] if end < 0 else text[end:a], mark]
            end = b
        end = max(end, b)
    return "".join(out) + text[max(end, 0) :] if found else text


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", labelled: list[tuple[str, str]] | None = None) -> DataFrame:
    """`docs` with the secrets of each text replaced by a mark; rows without secrets, and other columns, are unchanged.

    `length_col`, where it exists as a long, follows the text's new length.
    """
    automata = _learner(labelled)

    def run(batches):
        known = automata()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            changed = {}
            for i, t in enumerate(batch.column(at)):
                if (text := t.as_py()) and (found := spans(text, known)):
                    changed[i] = redacted(text, found)
            if changed:
                columns = batch.columns
                texts = batch.column(at).to_pylist()
                for i, t in changed.items():
                    texts[i] = t
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                n = batch.schema.get_field_index(length_col) if length_col else -1
                if n >= 0 and pa.types.is_int64(batch.schema.field(n).type):
                    lengths = batch.column(n).to_pylist()
                    for i, t in changed.items():
                        lengths[i] = len(t)
                    columns[n] = pa.array(lengths, pa.int64())
                batch = pa.record_batch(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)
