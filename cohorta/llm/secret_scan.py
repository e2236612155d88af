"""Secret scans with one deterministic automaton for all rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from cohorta.llm.common import append_columns

DIGITS = frozenset(range(48, 58))
UPPER = frozenset(range(65, 91))
LETTERS = UPPER | frozenset(range(97, 123))
HEX = DIGITS | frozenset(range(97, 103))
ALNUM = DIGITS | LETTERS


# A rule is a small tree: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most or None).
def chars(values) -> tuple:
    return ("set", frozenset(values))


def literal(word: str, either_case: bool = False) -> tuple:
    return cat(*[chars({ord(c), ord(c.lower()), ord(c.upper())} if either_case else {ord(c)}) for c in word])


def cat(*parts) -> tuple:
    return ("cat", parts)


def alt(*parts) -> tuple:
    return ("alt", parts)


def rep(part, least: int, most: int | None = None) -> tuple:
    return ("rep", part, least, most)


@dataclass(frozen=True)
class Rule:
    """A kind of secret, its pattern, and the least length of its last repeated part (0: any).

    That length is checked on the match, not counted in the automaton: counters of
    several rules that run side by side would multiply its states.
    """

    kind: str
    pattern: tuple
    least_run: int = 0


_QUOTE = rep(chars(b"\"'"), 0, 1)
_BLANKS = rep(chars(b" "), 0)
_VALUE = ALNUM | frozenset(b"+/_.=-")
_NAMES = alt(
    *(literal(w, True) for w in ("password", "passwd", "secret", "token")),
    cat(literal("api", True), rep(chars(b"_"), 0, 1), literal("key", True)),
)

# Assignments, access keys and long hexadecimal runs, in this order; then further kinds.
RULES = (
    Rule("assign", cat(_NAMES, _QUOTE, _BLANKS, chars(b":="), _BLANKS, _QUOTE, rep(chars(_VALUE), 1)), 6),
    Rule("access", cat(literal("AKIA"), rep(chars(UPPER | DIGITS), 1)), 16),
    Rule("hex", rep(chars(HEX), 24)),
    Rule("github", cat(literal("gh"), chars(b"pousr"), literal("_"), rep(chars(ALNUM), 1)), 36),
    Rule("slack", cat(literal("xox"), chars(b"abprs"), literal("-"), rep(chars(ALNUM | frozenset(b"-")), 1)), 10),
    Rule("private_key", cat(literal("-----BEGIN "), rep(chars(UPPER | {32}), 0), literal("PRIVATE KEY-----"))),
)


class _Nfa:
    """States with empty moves and moves on sets of bytes."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, node: tuple, start: int, backwards: bool) -> int:
        """Append a pattern after ``start``; returns its end state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for part in reversed(node[1]) if backwards else node[1]:
                start = self.add(part, start, backwards)
            return start
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                self.empty[self.add(part, start, backwards)].append(end)
            return end
        _, part, least, most = node
        for _ in range(least):
            start = self.add(part, start, backwards)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop, backwards)].append(loop)
            return loop
        end = self.state()
        self.empty[start].append(end)
        for _ in range(most - least):
            start = self.add(part, start, backwards)
            self.empty[start].append(end)
        return end


@dataclass(frozen=True)
class Dfa:
    """Transition array (256 per state), the rules each state accepts, the start, and the state without way out (or -1)."""

    table: list[int]
    accepts: list[int]
    start: int
    dead: int


def compile_rules(patterns: Sequence[tuple], anchored: bool, backwards: bool = False) -> Dfa:
    """One automaton for all patterns: subset construction, then minimisation by partition refinement."""
    nfa = _Nfa()
    root = nfa.state()
    finals = {}
    for k, pattern in enumerate(patterns):
        begin = nfa.state()
        nfa.empty[root].append(begin)
        finals[nfa.add(pattern, begin, backwards)] = 1 << k

    def closure(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for following in nfa.empty[todo.pop()]:
                if following not in seen:
                    seen.add(following)
                    todo.append(following)
        return frozenset(seen)

    # Bytes that no set tells apart share a class.
    sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    signature = [tuple(b in s for s in sets) for b in range(256)]
    classes = {s: c for c, s in enumerate(dict.fromkeys(signature))}
    of_byte = [classes[s] for s in signature]
    sample = {c: b for b, c in reversed(list(enumerate(of_byte)))}

    first = closure([root])
    number, order, rows = {first: 0}, [first], []
    for states in order:
        row = []
        for c in range(len(classes)):
            reached = {t for s in states for chosen, t in nfa.moves[s] if sample[c] in chosen}
            following = closure(reached if anchored else reached | {root})
            if following not in number:
                number[following] = len(order)
                order.append(following)
            row.append(number[following])
        rows.append(row)
    accepts = [0] * len(order)
    for n, states in enumerate(order):
        for s in states:
            accepts[n] |= finals.get(s, 0)

    # Split groups of states until all members of a group move alike.
    group, count = accepts, len(set(accepts))
    while True:
        keys = [(group[n], *[group[t] for t in rows[n]]) for n in range(len(rows))]
        names = {key: i for i, key in enumerate(dict.fromkeys(keys))}
        group = [names[key] for key in keys]
        if len(names) == count:
            break
        count = len(names)
    chosen = {g: n for n, g in reversed(list(enumerate(group)))}
    # Quiet states first, so that one comparison tells an accepting state.
    ranked = sorted(chosen, key=lambda g: (accepts[chosen[g]] != 0, g))
    place = {g: i for i, g in enumerate(ranked)}
    scaled = [i * 256 for i in range(len(ranked))]
    table: list[int] = []
    for g in ranked:
        row = rows[chosen[g]]
        table.extend(scaled[place[group[row[of_byte[b]]]]] for b in range(256))
    final = [accepts[chosen[g]] for g in ranked]
    dead = [n for n in scaled if not final[n >> 8] and all(t == n for t in table[n : n + 256])]
    return Dfa(table, final, scaled[place[group[0]]], dead[0] if dead else -1)


class SecretScanner:
    """All rules in one pass over the bytes; starts and ends are settled at the few accepting places."""

    def __init__(self, rules: Sequence[Rule] = RULES):
        self.rules = list(rules)
        self.all = compile_rules([r.pattern for r in rules], anchored=False)
        self.ahead = [compile_rules([r.pattern], anchored=True) for r in rules]
        self.back = [compile_rules([r.pattern], anchored=True, backwards=True) for r in rules]
        self.alone = [compile_rules([r.pattern], anchored=False) for r in rules]
        quiet = sum(1 for a in self.all.accepts if not a)
        self.loud = quiet * 256

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes: leftmost, longest, non-overlapping per rule."""
        table, loud, accepts = self.all.table, self.loud, self.all.accepts
        free, wait = [0] * len(self.rules), [0] * len(self.rules)
        found = []
        state = self.all.start
        for at, byte in enumerate(data):
            state = table[state + byte]
            if state >= loud:
                kinds = accepts[state >> 8]
                for k in range(len(free)):
                    if kinds >> k & 1 and at >= free[k] and at >= wait[k]:
                        start = self._start(k, data, free[k], at)
                        if start < 0:
                            # What ends here began in the match before: go on where the rule alone accepts.
                            wait[k] = self._next_end(k, data, free[k], at)
                            continue
                        end = self._end(k, data, start)
                        free[k] = end
                        if not self._long_enough(k, data, start, end):
                            continue
                        found.append((start, k, end))
        return sorted(found)

    def _start(self, k: int, data: bytes, low: int, at: int) -> int:
        """Leftmost start, not below ``low``, of a match that ends with byte ``at``."""
        dfa = self.back[k]
        state, start = dfa.start, -1
        for place in range(at, low - 1, -1):
            state = dfa.table[state + data[place]]
            if state == dfa.dead:
                break
            if dfa.accepts[state >> 8]:
                start = place
        return start

    def _next_end(self, k: int, data: bytes, low: int, at: int) -> int:
        """The first byte after ``at`` that ends a match which starts at ``low`` or later."""
        dfa = self.alone[k]
        state = dfa.start
        for place in range(low, len(data)):
            state = dfa.table[state + data[place]]
            if place > at and dfa.accepts[state >> 8]:
                return place
        return len(data)

    def _end(self, k: int, data: bytes, start: int) -> int:
        """End of the longest match from ``start``."""
        dfa = self.ahead[k]
        state, end = dfa.start, start
        for place in range(start, len(data)):
            state = dfa.table[state + data[place]]
            if state == dfa.dead:
                break
            if dfa.accepts[state >> 8]:
                end = place + 1
        return end

    def _long_enough(self, k: int, data: bytes, start: int, end: int) -> bool:
        """The last part, which begins where the match is first accepted, is long enough."""
        least, dfa = self.rules[k].least_run, self.ahead[k]
        state = dfa.start
        for place in range(start, end if least else start):
            state = dfa.table[state + data[place]]
            if dfa.accepts[state >> 8]:
                return end - place >= least
        return True


def text_spans(scanner: SecretScanner, text: str | None) -> list[tuple[int, int, int]]:
    """(start, rule, end) in code points."""
    data = (text or "").encode("utf-8", "surrogatepass")
    spans = scanner.spans(data)
    if not spans or len(data) == len(text):
        return spans
    at = point = 0
    place = {}
    for b in sorted({p for s, _, e in spans for p in (s, e)}):
        point += len(data[at:b].decode("utf-8", "surrogatepass"))
        place[b], at = point, b
    return [(place[s], k, place[e]) for s, k, e in spans]


def scan_secrets(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Append ``secrets``: an array of (kind, start, end) in code points, end exclusive, by start and rule.

    The automata are compiled once, before the job. Null and empty texts have no
    secrets; matches of one kind never overlap, those of different kinds may. An
    input column named ``secrets`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(SecretScanner(rules))

    def make() -> Callable[[list], list]:
        scanner = shared.value
        kinds = [r.kind for r in scanner.rules]

        def compute(texts: list) -> list:
            return [
                [[{"kind": kinds[k], "start": s, "end": e} for s, k, e in text_spans(scanner, t)] for t in texts]
            ]

        return compute

    return append_columns(df, text, "secrets array<struct<kind:string,start:long,end:long>>", make)


def redact(text: str, spans: Sequence[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """The text with each span, or run of overlapping spans, replaced by ``mark``."""
    parts, at = [], 0
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    for start, end in merged:
        parts += [text[at:start], mark]
        at = end
    return "".join([*parts, text[at:]])


def redact_secrets(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Append ``redacted``: the text with its secrets replaced; null stays null, clean texts stay as they are."""
    shared = df.sparkSession.sparkContext.broadcast(SecretScanner(rules))

    def make() -> Callable[[list], list]:
        scanner = shared.value

        def compute(texts: list) -> list:
            return [[t and redact(t, [(s, e) for s, _, e in text_spans(scanner, t)]) for t in texts]]

        return compute

    return append_columns(df, text, "redacted string", make)
