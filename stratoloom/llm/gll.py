"""Generalised LL recognition with graph-structured stacks over grammars in EBNF.

A grammar is written as rules ``name = alternatives ;``.  Every rule becomes a
small automaton whose edges read a terminal, enter another rule, or read a
*bracket group*: a stretch between two matching brackets, which the lexer has
already folded into one token.  Automata are made deterministic on demand.

Recognition walks the tokens from left to right and keeps all live
(automaton state, stack node) pairs of a position; stack nodes of one rule at
one position are shared, so ambiguity costs polynomial time, left recursion
through ``calls`` ends, and several start rules (dialects, or all the roles a
bracket group can play) run together over the same stacks.

The roles that a group's content can play are found once for each different
content and kept, so that repeated structure is recognised once.  Where a
grammar asks for it, statements are folded in the same way.
"""

from __future__ import annotations

import re

OPEN = "([{"
CLOSE = ")]}"
#: Kinds 0-3 open a group and 4-7 close it; 3 and 7 are indentation.
OPENERS = {"(": 0, "[": 1, "{": 2, "INDENT": 3}
#: A statement up to its terminator is folded like a bracket group, where some rule has it as ``SEGMENT x END``.
SEGMENT = 4
CLOSERS = {")": 4, "]": 5, "}": 6, "DEDENT": 7}
NEWLINE_FLAG = 1 << 20
GROUP_BASE = 1 << 12
END = -1

_TOKEN = re.compile(r"\s*(?:(#[^\n]*)|'((?:[^'\\]|\\.)+)'|([A-Za-z_]+)|(\.\.\.|&nl|[=;|()*+?]))")


class _Node:
    """A stack node: its edges are what happens after the rule it stands for ends."""

    __slots__ = ("edges", "popped", "root")

    def __init__(self, root: int = -1):
        self.edges: list = []
        self.popped = -1
        self.root = root


class Grammar:
    """A compiled grammar; ``words`` are the terminals that are spelled like words."""

    def __init__(self, text: str, memo_limit: int = 400_000):
        self.kind: dict[str, int] = {**OPENERS, **CLOSERS}
        self.rules: dict[str, tuple] = {}
        self.groups: list[tuple[int, str]] = []
        self._group_ids: dict[tuple[int, str], int] = {}
        self._read(text)
        self.words = {t for t in self.kind if re.fullmatch(r"[a-z_][A-Za-z_]*|[A-Z][a-z]+", t)}
        self._eps: list[list[int]] = []
        self._nl: list[list[int]] = []
        self._term: list[dict[int, list[int]]] = []
        self._grp: list[list[tuple[int, int]]] = []
        self._call: list[list[tuple[str, int]]] = []
        self.start: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for name in self.rules:
            self.start[name], self.final[name] = self._state(), self._state()
        for name, tree in self.rules.items():
            self._build(tree, self.start[name], self.final[name])
        self._finals = set(self.final.values())
        self._closures: dict[frozenset, frozenset] = {}
        self._ids: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self.table: list[dict[int, tuple]] = []
        self._first()
        self.entry = {n: self._dstate({self.start[n]}) for n in self.rules}
        self.by_bracket = [[(i, f"group{i}") for i, (b, _) in enumerate(self.groups) if b == br] for br in range(5)]
        self.segment_in: tuple[int, ...] = ()
        self.terminator = -1
        self._block_tokens: set[int] = set()
        self.classes: list[int] = []
        self._class_ids: dict[tuple[int, int], int] = {}
        self.memo: dict[tuple, int] = {}
        self.memo_limit = memo_limit

    # -- reading the notation ------------------------------------------------

    def _read(self, text: str) -> None:
        toks = []
        pos = 0
        text = text.rstrip()
        while pos < len(text):
            m = _TOKEN.match(text, pos)
            if not m:
                raise ValueError(f"grammar: {text[pos : pos + 40]!r}")
            pos = m.end()
            if m[2]:
                toks.append(("t", re.sub(r"\\(.)", r"\1", m[2])))
            elif m[3]:
                toks.append(("n", m[3]))
            elif m[4]:
                toks.append(("p", m[4]))
        self._toks, self._at = toks, 0
        while self._at < len(toks):
            name = toks[self._at][1]
            self._at += 2
            self.rules[name] = self._alt()
            if toks[self._at] != ("p", ";"):
                raise ValueError(f"grammar: rule {name} does not end at {toks[self._at]}")
            self._at += 1

    def _alt(self) -> tuple:
        parts = [self._seq()]
        while self._at < len(self._toks) and self._toks[self._at] == ("p", "|"):
            self._at += 1
            parts.append(self._seq())
        return parts[0] if len(parts) == 1 else ("alt", *parts)

    def _seq(self) -> tuple:
        parts = []
        while self._at < len(self._toks):
            what, s = self._toks[self._at]
            if what == "p" and s in ";|)" or what == "t" and s in CLOSERS or what == "n" and s in ("DEDENT", "END"):
                break
            self._at += 1
            if what == "p" and s == "(":
                item = self._alt()
                self._at += 1
            elif what == "p" and s == "...":
                item = ("any",)
            elif what == "p" and s == "&nl":
                item = ("nl",)
            elif what == "n" and s == "SEGMENT":
                inner = self._alt()
                self._at += 1
                item = ("group", self._group(SEGMENT, inner))
            elif s in OPENERS and what in "tn":
                inner = self._alt()
                self._at += 1
                item = ("group", self._group(OPENERS[s], inner))
            elif what == "t" or s.isupper():
                item = ("term", self.kind.setdefault(s, 8 + len(self.kind) - 8))
            else:
                item = ("call", s)
            while self._at < len(self._toks) and self._toks[self._at][0] == "p" and self._toks[self._at][1] in "*+?":
                item = (self._toks[self._at][1], item)
                self._at += 1
            parts.append(item)
        return ("seq", *parts)

    def _group(self, bracket: int, inner: tuple) -> int:
        key = (bracket, repr(inner))
        if key not in self._group_ids:
            n = self._group_ids[key] = len(self.groups)
            self.groups.append((bracket, key[1]))
            self.rules[f"group{n}"] = inner
        return self._group_ids[key]

    # -- automata ------------------------------------------------------------

    def _state(self) -> int:
        self._eps.append([])
        self._nl.append([])
        self._term.append({})
        self._grp.append([])
        self._call.append([])
        return len(self._eps) - 1

    def _build(self, tree: tuple, a: int, b: int) -> None:
        op, rest = tree[0], tree[1:]
        if op == "seq":
            for i, part in enumerate(rest):
                c = b if i == len(rest) - 1 else self._state()
                self._build(part, a, c)
                a = c
            if not rest:
                self._eps[a].append(b)
        elif op == "alt":
            for part in rest:
                self._build(part, a, b)
        elif op == "term":
            self._term[a].setdefault(rest[0], []).append(b)
        elif op == "group":
            self._grp[a].append((rest[0], b))
        elif op == "call":
            if rest[0] not in self.rules:
                raise ValueError(f"grammar: no rule {rest[0]}")
            self._call[a].append((rest[0], b))
        elif op == "nl":
            self._nl[a].append(b)
        elif op == "any":
            self._term[a].setdefault(-2, []).append(a)
            self._eps[a].append(b)
        else:
            c, d = self._state(), self._state()
            self._eps[a].append(c)
            self._build(rest[0], c, d)
            self._eps[d].append(b)
            if op in "*?":
                self._eps[a].append(b)
            if op in "*+":
                self._eps[d].append(c)

    def _closure(self, states: frozenset, newline: bool) -> frozenset:
        out, todo = set(states), list(states)
        while todo:
            s = todo.pop()
            for x in self._eps[s] + (self._nl[s] if newline else []):
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return frozenset(out)

    def _dstate(self, states) -> int:
        s = self._closure(frozenset(states), False)
        if s not in self._ids:
            self._ids[s] = len(self._sets)
            self._sets.append(s)
            self.table.append({})
        return self._ids[s]

    def _first(self) -> None:
        """Which terminals and groups a rule can begin with, and whether it can be empty."""
        self.nullable = set()
        self.first_t = {n: set() for n in self.rules}
        self.first_g = {n: set() for n in self.rules}
        changed = True
        while changed:
            changed = False
            for n in self.rules:
                before = (n in self.nullable, len(self.first_t[n]), len(self.first_g[n]))
                seen, todo = {self.start[n]}, [self.start[n]]
                while todo:
                    s = todo.pop()
                    self.first_t[n] |= self._term[s].keys()
                    self.first_g[n] |= {g for g, _ in self._grp[s]}
                    on = self._eps[s] + self._nl[s]
                    for callee, after in self._call[s]:
                        self.first_t[n] |= self.first_t[callee]
                        self.first_g[n] |= self.first_g[callee]
                        if callee in self.nullable:
                            on = [*on, after]
                    for x in on:
                        if x not in seen:
                            seen.add(x)
                            todo.append(x)
                if self.final[n] in seen:
                    self.nullable.add(n)
                changed |= before != (n in self.nullable, len(self.first_t[n]), len(self.first_g[n]))

    def _viable(self, rule: str, t: int) -> bool:
        if rule in self.nullable or -2 in self.first_t[rule]:
            return True
        if t == END:
            return False
        if t < GROUP_BASE:
            return t in self.first_t[rule]
        return any(self.classes[t - GROUP_BASE] >> g & 1 for g in self.first_g[rule])

    def _action(self, d: int, token: int) -> tuple:
        """(may the rule end here, rules to enter with the state to go on from, next state)."""
        t = token if token == END else token & (NEWLINE_FLAG - 1)
        states = self._sets[d]
        if token == END or token & NEWLINE_FLAG:
            states = self._closure(states, True)
        ends = not states.isdisjoint(self._finals)
        calls: dict[str, set] = {}
        nxt: set[int] = set()
        for s in states:
            for rule, after in self._call[s]:
                if self._viable(rule, t):
                    calls.setdefault(rule, set()).add(after)
            if t == END:
                continue
            nxt.update(self._term[s].get(-2, ()))
            if t < GROUP_BASE:
                nxt.update(self._term[s].get(t, ()))
            else:
                mask = self.classes[t - GROUP_BASE]
                nxt.update(after for g, after in self._grp[s] if mask >> g & 1)
        out = (ends, tuple((self.entry[r], r, self._dstate(after)) for r, after in calls.items()), self._dstate(nxt) if nxt else -1)
        self.table[d][token] = out
        return out

    # -- recognition ---------------------------------------------------------

    def run(self, tokens: tuple, starts: list[tuple[int, str]]) -> int:
        """The bits of those start rules that derive exactly these tokens."""
        table, action = self.table, self._action
        cur: list = []
        t0 = tokens[0] if tokens else END
        for bit, rule in starts:
            if self._viable(rule, t0 if t0 == END else t0 & (NEWLINE_FLAG - 1)):
                cur.append((self.entry[rule], _Node(bit)))
        n, result = len(tokens), 0
        for i in range(n + 1):
            if not cur:
                return result
            t = tokens[i] if i < n else END
            nxt: list = []
            if len(cur) == 1:
                d, node = cur[0]
                ends, calls, to = table[d].get(t) or action(d, t)
                if not calls and not ends:
                    cur = [(to, node)] if to >= 0 else nxt
                    continue
            seen, nxt_seen, fresh = set(cur), set(), {}
            j = 0
            while j < len(cur):
                d, node = cur[j]
                j += 1
                ends, calls, to = table[d].get(t) or action(d, t)
                if ends:
                    if node.root >= 0:
                        if t == END:
                            result |= 1 << node.root
                    else:
                        node.popped = i
                        for e in node.edges:
                            if e not in seen:
                                seen.add(e)
                                cur.append(e)
                for begin, rule, after in calls:
                    child = fresh.get(rule)
                    if child is None:
                        child = fresh[rule] = _Node()
                        cur.append((begin, child))
                    e = (after, node)
                    if e not in child.edges:
                        child.edges.append(e)
                        if child.popped == i and e not in seen:
                            seen.add(e)
                            cur.append(e)
                if to >= 0:
                    e = (to, node)
                    if e not in nxt_seen:
                        nxt_seen.add(e)
                        nxt.append(e)
            cur = nxt
        return result

    def group(self, bracket: int, content: tuple) -> int:
        """The token for a group of this content, or 0 if no rule has such a group."""
        key = (bracket, content)
        t = self.memo.get(key)
        if t is None:
            mask = self.run(content, self.by_bracket[bracket])
            if mask:
                k = self._class_ids.get((bracket, mask))
                if k is None:
                    k = self._class_ids[bracket, mask] = len(self.classes)
                    self.classes.append(mask)
                    if bracket == 3:
                        self._block_tokens.add(GROUP_BASE + k)
                t = GROUP_BASE + k
            else:
                t = 0
            if len(self.memo) >= self.memo_limit:
                self.memo.clear()
            self.memo[key] = t
        return t

    def fold(self, kinds: list[int], newlines: bool = True, whole: bool = True) -> tuple | None:
        """Fold the bracket groups of a token list; None if they do not match or fit no rule.

        ``whole`` says that the tokens are a whole text, whose statements may be folded.  With ``newlines``, tokens may carry newline marks; they are dropped inside round and square brackets.
        """
        mask = NEWLINE_FLAG - 1
        stack: list = []
        cur: list = []
        at = 0
        # only brackets need a step of their own; what lies between is copied as it is
        for i in [i for i, k in enumerate(kinds) if k & mask < 8]:
            k = kinds[i]
            if i > at:
                cur += kinds[at:i]
            at = i + 1
            low = k & mask
            if low < 4:
                stack.append((cur, k))
                cur = []
                continue
            if not stack:
                return None
            above, opener = stack.pop()
            bracket = opener & mask
            if bracket != low - 4:
                return None
            if bracket < 2 and newlines:
                cur = [x & mask for x in cur]
            if bracket in self.segment_in:
                cur = self.segments(cur)
            t = self.group(bracket, tuple(cur))
            if not t:
                return None
            cur = above
            cur.append(t | (opener & NEWLINE_FLAG))
        cur += kinds[at:]
        if stack:
            return None
        return tuple(self.segments(cur) if self.segment_in and whole else cur)

    def segments(self, content: list[int]) -> list[int]:
        """The content with its statements folded, each up to its terminator; what no rule has stays as it is."""
        term, blocks = self.terminator, self._block_tokens
        out: list[int] = []
        start = 0
        for i in [i for i, k in enumerate(content) if k == term or k in blocks]:
            if content[i] != term:
                out += content[start : i + 1]
            else:
                part = tuple(content[start : i + 1])
                t = self.group(SEGMENT, part)
                if t:
                    out.append(t)
                else:
                    out += part
            start = i + 1
        out += content[start:]
        return out

    def accepts(self, kinds: list[int], dialects: list[str], newlines: bool = True) -> bool:
        """Whether any of the dialects' start rules derives the tokens."""
        folded = self.fold(kinds, newlines)
        return folded is not None and self.run(folded, list(enumerate(dialects))) != 0
