"""The predicate language: an expression compiled to columns.

An expression is one predicate, or several joined by && (all) or || (any). If it holds ||
anywhere, only || splits. There are no parentheses, no negation and no escapes. A predicate
is re:, prefix:, suffix: or lit: with a value, or bare text, which is a literal. Everything
is matched on bytes: lines are text, or, for a plan on_bytes(), one character for each byte,
which needn't be valid UTF-8.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from linequarry.functions import byte_regex as rx

#: A regular expression with no special class is reduced to its required literal only if that has so many bytes.
LEAST_LITERAL = 4
SPECIAL = frozenset("\\.^$*+?()[]{}|")


class ExpressionError(ValueError):
    """The expression is not one of the language."""


def byte_view(column: Column) -> Column:
    """Text with one character for each byte of its UTF-8 form."""
    return F.decode(F.encode(column, "UTF-8"), "ISO-8859-1")


def shown(column: Column) -> Column:
    """What a byte view stands for, as text: invalid bytes replaced."""
    return F.make_valid_utf8(F.encode(column, "ISO-8859-1").cast("string"))


def plain(value: str) -> bool:
    return bool(value) and not SPECIAL & set(value)


def one_width(value: str) -> bool:
    """Whether every character keeps its UTF-8 length in either case."""
    same = lambda c, d: len(d) == 1 and len(d.encode()) == len(c.encode())
    return all(same(c, c.lower()) and same(c, c.upper()) for c in value)


@dataclass(frozen=True)
class Predicate:
    kind: str  # literal, prefix, suffix, regex
    value: str
    raw: bool = False  # lines are byte views

    # --- what kind of regular expression it is

    @property
    def fold(self) -> bool:
        return self.kind == "regex" and self.value.startswith("(?i)")

    @property
    def core(self) -> str:
        return self.value[4:] if self.fold else self.value

    @property
    def strategy(self) -> str:
        """The recogniser class, which also decides what a count without hits counts."""
        if self.kind != "regex":
            return self.kind
        fold = "case_fold_" if self.fold else ""
        if self.word_bounded:
            return fold + "word_bounded_literal"
        if plain(self.core):
            if not self.fold:
                return "plain_literal"
            return "case_fold_literal" if self.core.isascii() else "unicode_case_fold_literal" if one_width(self.core) else self.by_literal
        if self.core[:1] == "(" and self.core[-1:] == ")" and len(parts := self.core[1:-1].split("|")) > 1 and all(plain(p) and p.isascii() for p in parts):
            return fold + "literal_alternation"
        return self.by_literal

    @property
    def by_literal(self) -> str:
        literal = rx.required_literal(self.tree)
        return "decomposed" if literal and len(literal) >= LEAST_LITERAL else "generic"

    @property
    def tree(self) -> object:
        return rx.parse(self.value)

    @property
    def word_bounded(self) -> bool:
        c = self.core
        return self.kind == "regex" and len(c) > 4 and c.startswith("\\b") and c.endswith("\\b") and plain(c[2:-2]) and c.isascii()

    @property
    def java(self) -> str:
        if self.word_bounded:
            # No word byte on either side, even if the literal itself begins or ends with another byte.
            w = rx.of_class(rx.WORD)
            return f"(?<!{w})(?:{rx.to_java(rx.parse('(?i)' * self.fold + self.core[2:-2]))})(?!{w})"
        return rx.to_java(rx.parse(self.value))

    @property
    def required_bytes(self) -> bytes | None:
        """Bytes that every line with a match holds, if they are known."""
        if self.kind != "regex":
            return self.value.encode()
        if self.word_bounded:
            return None if self.fold else self.core[2:-2].encode()
        return rx.required_literal(rx.parse(self.value))

    @property
    def required(self) -> str | None:
        """The same as text, if it is whole characters."""
        try:
            return self.required_bytes.decode() if self.required_bytes else None
        except UnicodeDecodeError:
            return None

    def gate(self, text: Column) -> Column | None:
        """Whether text holds what a match requires; None if that isn't known."""
        if self.raw:
            return text.contains(F.lit(self.required_bytes.decode("latin-1"))) if self.required_bytes else None
        return text.contains(F.lit(self.required)) if self.required else None

    @property
    def ascii(self) -> bool:
        return self.value.isascii() and (self.kind != "regex" or self.word_bounded or rx.is_ascii(rx.parse(self.value)))

    # --- columns

    def held(self, value: str) -> str:
        """A value as the lines spell it."""
        return value.encode().decode("latin-1") if self.raw else value

    def view(self, line: Column) -> Column:
        """A line as the regular expression reads it."""
        return line if self.raw or self.ascii else byte_view(line)

    def n_bytes(self, line: Column) -> Column:
        return (F.char_length(line) if self.raw else F.octet_length(line)).cast("long")

    def matches(self, line: Column) -> Column:
        """Whether a line (without its end) matches."""
        if self.kind == "literal" or self.strategy == "plain_literal":
            return line.contains(F.lit(self.held(self.value)))
        if self.kind == "prefix":
            return line.startswith(F.lit(self.held(self.value)))
        if self.kind == "suffix":
            return line.endswith(F.lit(self.held(self.value)))
        if self.strategy == "literal_alternation":
            return reduce(Column.__or__, (line.contains(F.lit(p)) for p in self.core[1:-1].split("|")))
        test, gate = self.view(line).rlike(self.java), self.gate(line)
        return test if gate is None else gate & test

    def column(self, line: Column) -> Column:
        """1-based byte place of the first match, null without one."""
        before = lambda at: at.cast("long") if self.raw else F.octet_length(F.substring(line, F.lit(1), at - 1)).cast("long") + 1
        if self.kind == "prefix":
            return F.when(self.matches(line), F.lit(1).cast("long"))
        if self.kind == "suffix":
            return F.when(self.matches(line), self.n_bytes(line) - len(self.value.encode()) + 1)
        if self.kind == "literal" or self.strategy == "plain_literal":
            at = F.instr(line, self.held(self.value))
            return F.when(at > 0, before(at))
        at = F.regexp_instr(self.view(line), F.lit(self.java))
        return F.when(at > 0, before(at) if self.ascii else at.cast("long"))

    def occurrences(self, text: Column) -> Column:
        """Matches that don't overlap, leftmost first, over the whole text."""
        if self.kind == "literal" or self.strategy == "plain_literal":
            # Non-overlapping by construction: what replace() takes out, in units of the literal.
            n = len(self.value.encode())
            return ((self.n_bytes(text) - self.n_bytes(F.replace(text, F.lit(self.held(self.value)), F.lit("")))) / n).cast("long")
        if self.kind in ("prefix", "suffix"):
            raise ExpressionError("prefix and suffix have lines to count, not occurrences")
        view = self.view(text)
        if not rx.nullable(rx.parse(self.value)):
            return F.regexp_count(view, F.lit(self.java)).cast("long")
        # An empty match right after another match doesn't count.
        every = F.regexp_extract_all(view, F.lit(f"({self.java})"), F.lit(1))
        pairs = F.zip_with(every, F.concat(F.array(F.lit("")), every), lambda a, b: (a == "") & (b.isNotNull()) & (b != ""))
        return (F.size(every) - F.size(F.filter(pairs, lambda x: x))).cast("long")

    def unicode_occurrences(self, text: Column) -> Column:
        """Of a case-folded literal, by the Unicode text's own case mapping."""
        import re

        return F.regexp_count(shown(text) if self.raw else text, F.lit("(?iu)" + re.sub(r"([^\w\s])", r"\\\1", self.core))).cast("long")


@dataclass(frozen=True)
class Plan:
    source: str
    mode: str  # all, any
    predicates: tuple[Predicate, ...]

    def on_bytes(self) -> Plan:
        """The plan for lines that are byte views."""
        return replace(self, predicates=tuple(replace(p, raw=True) for p in self.predicates))

    @property
    def raw(self) -> bool:
        return any(p.raw for p in self.predicates)

    def shown(self, line: Column) -> Column:
        return shown(line) if self.raw else line

    def n_bytes(self, text: Column) -> Column:
        return self.predicates[0].n_bytes(text)

    def predicate(self, line: Column) -> Column:
        tests = [p.matches(line) for p in sorted(self.predicates, key=lambda p: p.kind == "regex")]  # cheap ones first
        return reduce(Column.__and__ if self.mode == "all" else Column.__or__, tests)

    def column(self, line: Column) -> Column:
        """Byte place of the earliest match of any predicate; 1 if there is none."""
        places = [p.column(line) for p in self.predicates]
        return F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.lit(1)).cast("long")

    def prefilter(self, text: Column) -> Column | None:
        """A sound test of a whole file's text: false only if no line can match. None if there is no cheap one."""
        gates = [p.gate(text) for p in self.predicates]
        tests = [g for g in gates if g is not None]
        if self.mode == "any":
            return reduce(Column.__or__, tests) if len(tests) == len(gates) else None
        return reduce(Column.__and__, tests) if tests else None

    @property
    def single(self) -> Predicate | None:
        return self.predicates[0] if len(self.predicates) == 1 else None

    def explain(self) -> dict:
        return {
            "source": self.source,
            "mode": self.mode,
            "predicates": [{"type": p.kind, "value": p.value} for p in self.predicates],
            "strategies": [p.strategy for p in self.predicates],
            "required": [p.required for p in self.predicates],
        }

    def explain_json(self) -> str:
        return json.dumps(self.explain(), ensure_ascii=False)


def parse_predicate(token: str) -> Predicate:
    for tag, kind in (("re:", "regex"), ("prefix:", "prefix"), ("suffix:", "suffix"), ("lit:", "literal")):
        if token.startswith(tag):
            value = token[len(tag) :]
            break
    else:
        kind, value = "literal", token
    if kind == "regex":
        try:
            rx.parse(value)
        except rx.RegexError as e:
            raise ExpressionError(f"invalid regular expression {value!r}: {e}") from e
    elif not value:
        raise ExpressionError(f"{kind} predicate without a value")
    return Predicate(kind, value)


def parse(expression: str) -> Plan:
    source = expression.strip()
    if not source:
        raise ExpressionError("the expression is empty")
    mode, tokens = "all", [source]
    if "||" in source:
        mode, tokens = "any", source.split("||")
    elif "&&" in source:
        tokens = source.split("&&")
    tokens = [t for t in map(str.strip, tokens) if t]
    if not tokens:
        raise ExpressionError("the expression holds no predicate")
    return Plan(source, mode, tuple(map(parse_predicate, tokens)))
