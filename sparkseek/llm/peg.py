"""A packrat parser for parsing-expression grammars over token lists.

Grammar text: one rule per line, ``name <- choice / choice``; ``'x'`` is a literal token, a bare name a rule, ``( )``
group, ``* + ?`` repeat, ``& !`` look ahead. Upper-case names are token classes (``ID``, ``NUM``, ``STR``), ``END`` the end of the list. Bracketed groups
are written ``{rule}``, ``(|rule|)`` and ``[rule]``: in a token list they are either open tokens, or one token that stands
for a group already parsed, whose meaning says which rules its content satisfies.
"""

from __future__ import annotations

import re

_LEX = re.compile(r"\s*(<-|'(?:[^']+)'|\(\||\|\)|[A-Za-z_]\w*|[()\[\]{}*+?&!/])")
_CLOSE = {"(": ")", "[": "]", "{": "}"}


class Grammar:
    """Compiled rules. A parsing expression is a function (state, position) -> new position or -1."""

    def __init__(self, text: str, classes: dict[str, frozenset[str]]) -> None:
        self.classes = classes
        self.rules: dict[str, object] = {}
        for line in text.strip().split("\n"):
            line = line.split("##")[0].strip()
            if line:
                name, _, body = line.partition("<-")
                self.tokens = _LEX.findall(body)
                self.at = 0
                self.rules[name.strip()] = self._choice()
                if self.at != len(self.tokens):
                    raise ValueError(f"bad rule {line!r}")

    def _peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def _choice(self):
        options = [self._sequence()]
        while self._peek() == "/":
            self.at += 1
            options.append(self._sequence())
        if len(options) == 1:
            return options[0]

        def choice(s, i):
            for o in options:
                j = o(s, i)
                if j >= 0:
                    return j
            return -1

        return choice

    def _sequence(self):
        parts = []
        while self._peek() and self._peek() not in ("/", ")", "|)", "]", "}"):
            parts.append(self._item())
        if len(parts) == 1:
            return parts[0]

        def sequence(s, i):
            for p in parts:
                i = p(s, i)
                if i < 0:
                    return -1
            return i

        return sequence

    def _item(self):
        if self._peek() in ("&", "!"):
            negative = self._peek() == "!"
            self.at += 1
            inner = self._item()
            return lambda s, i: i if (inner(s, i) < 0) == negative else -1
        atom = self._atom()
        while self._peek() in ("*", "+", "?"):
            atom = self._repeat(atom, self._peek())
            self.at += 1
        return atom

    @staticmethod
    def _repeat(inner, kind):
        if kind == "?":
            return lambda s, i: j if (j := inner(s, i)) >= 0 else i

        def many(s, i):
            n = 0
            while (j := inner(s, i)) > i:
                i, n = j, n + 1
            return i if n or kind == "*" else -1

        return many

    def _atom(self):
        token = self._peek()
        self.at += 1
        if token == "(":
            inner = self._choice()
            self._need(")")
            return inner
        if token in ("{", "[", "(|"):
            rule = self._peek()
            self.at += 1
            self._need({"{": "}", "[": "]", "(|": "|)"}[token])
            return self._group(token[0], rule)
        if token == "END":
            return lambda s, i: i if i == len(s.tokens) else -1
        if token[0] == "'":
            literal = token[1:-1]
            return lambda s, i: s.token(i, literal)
        if token in self.classes:
            members = self.classes[token]
            return lambda s, i: s.any_of(i, members)
        return lambda s, i: s.rule(token, i)

    def _need(self, token: str) -> None:
        if self._peek() != token:
            raise ValueError(f"expected {token} in a rule")
        self.at += 1

    @staticmethod
    def _group(opening, rule):
        closing = _CLOSE[opening]

        def group(s, i):
            kinds = s.kinds.get(s.tokens[i]) if i < len(s.tokens) else None
            if kinds is not None:
                if opening + rule in kinds:
                    s.far = max(s.far, i + 1)
                    return i + 1
                return -1
            j = s.token(i, opening)
            if j < 0:
                return -1
            j = s.rule(rule, j)
            return s.token(j, closing) if j >= 0 else -1

        return group

    def parse(self, rule: str, tokens: list[str], kinds: dict[str, frozenset[str]] | None = None) -> tuple[bool, int]:
        """Whether the rule consumes all tokens, and the furthest token that any attempt reached."""
        state = _State(self.rules, tokens, kinds or {})
        end = state.rule(rule, 0)
        return end == len(tokens), state.far


class _State:
    __slots__ = ("far", "kinds", "memo", "rules", "tokens")

    def __init__(self, rules, tokens, kinds) -> None:
        self.rules, self.tokens, self.kinds, self.memo, self.far = rules, tokens, kinds, {}, 0

    def token(self, i: int, literal: str) -> int:
        if i < len(self.tokens) and self.tokens[i] == literal:
            if i + 1 > self.far:
                self.far = i + 1
            return i + 1
        return -1

    def any_of(self, i: int, members: frozenset[str]) -> int:
        if i < len(self.tokens) and self.tokens[i] in members:
            if i + 1 > self.far:
                self.far = i + 1
            return i + 1
        return -1

    def rule(self, name: str, i: int) -> int:
        key = (name, i)
        found = self.memo.get(key)
        if found is None:
            found = self.memo[key] = self.rules[name](self, i)
        return found
