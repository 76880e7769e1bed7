"""Byte regular expressions for a backtracking engine that works on strings.

The predicate language matches bytes, with ASCII-only classes and no Unicode tables, and
leftmost-first alternation. parse() reads that dialect into a small tree over bytes;
to_java() writes a tree as a Java pattern for text in which every character stands for one
byte (ISO-8859-1), spelling out all classes, case variants, anchors and word boundaries, so
that nothing depends on Java's own meaning of \\b, \\w, '.', '$' or its flags. What the
dialect lacks (look-around, back-references, possessive quantifiers, Unicode classes) is
refused although Java has it.

A pattern has to make sense for text and for bytes. Flags: i, m, s, x, U, R (lines end at
"\\r\\n", "\\r" or "\\n") and u. Under (?u) a dot is one UTF-8 character, and what would need Unicode
tables (classes, word boundaries) is refused; under (?-u) what could match part of a
character is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

DIGIT = frozenset(range(0x30, 0x3A))
WORD = DIGIT | frozenset(range(0x41, 0x5B)) | frozenset(range(0x61, 0x7B)) | {0x5F}
SPACE = frozenset(b" \t\n\r\x0b\x0c")
EVERY = frozenset(range(256))
UPPER, LOWER = frozenset(range(0x41, 0x5B)), frozenset(range(0x61, 0x7B))
PRINT = frozenset(range(0x21, 0x7F))
#: The POSIX class names of bracket expressions.
POSIX = {
    "alnum": DIGIT | UPPER | LOWER, "alpha": UPPER | LOWER, "ascii": frozenset(range(128)), "blank": frozenset(b" \t"),
    "cntrl": frozenset(range(32)) | {127}, "digit": DIGIT, "graph": PRINT, "lower": LOWER, "print": PRINT | {32},
    "punct": PRINT - DIGIT - UPPER - LOWER, "space": SPACE, "upper": UPPER, "word": WORD, "xdigit": DIGIT | frozenset(b"abcdefABCDEF"),
}
SIMPLE = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11, "a": 7}
#: A fixed value: the bytes of UTF-8 characters of two to four bytes.
CONTINUED = (0x80, 0xBF)
UTF8 = [
    [(0xC2, 0xDF), CONTINUED], [(0xE0, 0xE0), (0xA0, 0xBF), CONTINUED], [(0xE1, 0xEC), CONTINUED, CONTINUED], [(0xED, 0xED), (0x80, 0x9F), CONTINUED], [(0xEE, 0xEF), CONTINUED, CONTINUED],
    [(0xF0, 0xF0), (0x90, 0xBF), CONTINUED, CONTINUED], [(0xF1, 0xF3), CONTINUED, CONTINUED, CONTINUED], [(0xF4, 0xF4), (0x80, 0x8F), CONTINUED, CONTINUED],
]
#: Most states (bytes and choices, repeats written out) of a pattern; more would pass a compiled size of 10 MiB at 64 bytes a state.
MOST_STATES = 10 * 2**20 // 64
WORD_ENDS = {"start": "word_start", "end": "word_end", "start-half": "word_start_half", "end-half": "word_end_half"}
CLASSES = {"d": DIGIT, "w": WORD, "s": SPACE, "D": EVERY - DIGIT, "W": EVERY - WORD, "S": EVERY - SPACE}


class RegexError(ValueError):
    """The pattern is not one of the dialect."""


@dataclass(frozen=True)
class Literal:
    data: bytes


@dataclass(frozen=True)
class Class:
    members: frozenset


@dataclass(frozen=True)
class Look:
    kind: str  # a key of LOOKS


@dataclass(frozen=True)
class Repeat:
    sub: object
    least: int
    most: int | None
    greedy: bool


@dataclass(frozen=True)
class Group:
    sub: object


@dataclass(frozen=True)
class Concat:
    parts: tuple = ()


@dataclass(frozen=True)
class Alternation:
    parts: tuple = ()


@dataclass
class Parser:
    text: str
    at: int = 0
    flags: dict = field(default_factory=lambda: dict.fromkeys("imsxUR", False) | {"u": None})

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self) -> str:
        if self.at >= len(self.text):
            raise RegexError("the pattern ends too early")
        self.at += 1
        return self.text[self.at - 1]

    def whole(self) -> object:
        tree = self.alternation()
        if self.at < len(self.text):
            raise RegexError("unopened group")
        if states(tree) > MOST_STATES:
            raise RegexError("the pattern is too big")
        return tree

    def partial(self, what: bool) -> None:
        """Refuses what can match a part of a character where Unicode was turned off."""
        if what and self.flags["u"] is False:
            raise RegexError("without Unicode this could match a part of a character")

    def tables(self) -> None:
        if self.flags["u"]:
            raise RegexError("Unicode classes and word boundaries are not supported")

    def alternation(self) -> object:
        outer, branches = dict(self.flags), [self.concat()]
        while self.peek() == "|":
            self.at += 1
            branches.append(self.concat())
        self.flags = outer
        return branches[0] if len(branches) == 1 else Alternation(tuple(branches))

    def concat(self) -> object:
        parts: list = []
        while self.at < len(self.text) and self.peek() not in "|)":
            if self.flags["x"] and self.peek().isspace():
                self.at += 1
                continue
            if self.flags["x"] and self.peek() == "#":
                while self.at < len(self.text) and self.take() != "\n":
                    pass
                continue
            if (atom := self.atom()) is not None:
                parts.append(self.repeated(atom))
        merged: list = []
        for p in parts:  # neighbouring literals are one
            if isinstance(p, Literal) and merged and isinstance(merged[-1], Literal):
                merged[-1] = Literal(merged[-1].data + p.data)
            else:
                merged.append(p)
        return merged[0] if len(merged) == 1 else Concat(tuple(merged))

    def repeated(self, atom: object) -> object:
        while (c := self.peek()) and c in "*+?{":
            self.at += 1
            if c == "{":
                end = self.text.find("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",") if end >= 0 else ("", "", "")
                low, high = low.strip(), high.strip()
                if not low.isdigit() or (high and not high.isdigit()) or (high and int(high) < int(low)):
                    raise RegexError("malformed repetition count")
                self.at, least, most = end + 1, int(low), int(high) if high else None if comma else int(low)
            else:
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            lazy = self.peek() == "?"
            self.at += lazy
            if isinstance(atom, Literal) and len(atom.data) > 1:  # of a character of several bytes
                atom = Group(atom)
            atom = Repeat(atom, least, most, lazy == self.flags["U"])
        return atom

    def atom(self) -> object | None:
        c = self.take()
        if c in "*+?{":
            raise RegexError("nothing to repeat")
        if c == "(":
            return self.group()
        if c == "[":
            return self.bracket()
        if c == ".":
            self.partial(True)
            members = EVERY if self.flags["s"] else EVERY - {10, 13} if self.flags["R"] else EVERY - {10}
            return character(members) if self.flags["u"] else Class(members)
        if c in "^$":
            way = "start" if c == "^" else "end"
            return Look(way if not self.flags["m"] else f"{'crlf' if self.flags['R'] else 'line'}_{way}")
        if c == "\\":
            e = self.take()
            if e in "bB<>":
                self.tables()
                if e in "<>":
                    return Look("word_start" if e == "<" else "word_end")
                end = self.text.find("}", self.at)
                if e == "b" and self.peek() == "{" and self.text[self.at + 1 : end] in WORD_ENDS:
                    name, self.at = self.text[self.at + 1 : end], end + 1
                    return Look(WORD_ENDS[name])
                return Look("word" if e == "b" else "not_word")
            if e in "Az":
                return Look("start" if e == "A" else "end")
            if e in CLASSES:
                self.tables()
                self.partial(e.isupper())
                return Class(CLASSES[e])
            return self.literal(self.escape(e))
        return self.literal(c.encode())

    def literal(self, data: bytes) -> object:
        if self.flags["i"] and len(data) == 1 and data.isalpha():
            both = Class(frozenset(data.lower() + data.upper()))
            also = {b"k": "\u212a", b"s": "\u017f"}.get(data.lower()) if self.flags["u"] else None
            return Group(Alternation((both, Literal(also.encode())))) if also else both
        if self.flags["i"] and self.flags["u"] and not data.isascii():
            raise RegexError("Unicode case folding is not supported")
        return Literal(data)

    def group(self) -> object | None:
        outer = dict(self.flags)
        if self.peek() == "?":
            self.at += 1
            if self.peek(2) == "P<" or (self.peek() == "<" and self.peek(2) not in ("<=", "<!")):
                end = self.text.find(">", self.at)
                name = self.text[self.text.index("<", self.at) + 1 : end]
                if end < 0 or not name or not (name[0].isalpha() or name[0] == "_"):
                    raise RegexError("malformed group name")
                self.at = end + 1
            elif self.peek() in "=!<>P":
                raise RegexError("look-around and atomic groups are not supported")
            else:
                on = True
                while (f := self.take()) not in ":)":
                    if f == "-":
                        on = False
                    elif f in self.flags:
                        self.flags[f] = on
                    else:
                        raise RegexError(f"flag {f!r} is not supported")
                if f == ")":
                    return None  # the flags hold to the end of the enclosing group
        sub = self.alternation()
        if self.peek() != ")":
            raise RegexError("unclosed group")
        self.at += 1
        self.flags = outer
        return Group(sub)

    def escape(self, e: str) -> bytes:
        if e in SIMPLE:
            return bytes([SIMPLE[e]])
        if e in "xuU":
            if self.peek() == "{":
                end = self.text.find("}", self.at)
                digits, self.at = self.text[self.at + 1 : end], end + 1
            else:
                n = {"x": 2, "u": 4, "U": 8}[e]
                digits, self.at = self.peek(n), self.at + n
            try:
                code = int(digits, 16)
                # Without Unicode, \xHH is a byte.
                self.partial(e == "x" and 127 < code < 256)
                if self.flags["u"]:
                    return chr(code).encode()
                return bytes([code]) if e == "x" and code < 256 else chr(code).encode()
            except (ValueError, OverflowError):
                raise RegexError("malformed hexadecimal escape") from None
        if e.isalnum() or e.isspace() or ord(e) > 127:
            raise RegexError(f"escape \\{e} is not supported")
        return e.encode()

    def bracket(self) -> Class:
        """A class in brackets: items, and &&, -- and ~~ between what stands on their two sides, from left to right."""
        self.tables()
        negated, members = self.peek() == "^", frozenset()
        self.at += negated
        self.partial(negated)
        while self.peek() == "-":  # at the beginning it stands for itself
            self.at, members = self.at + 1, frozenset(b"-")
        left, operation, first = None, "", not members
        while True:
            c = self.take()
            if c == "]" and not first:
                break
            if c + self.peek() in ("&&", "--", "~~"):
                self.at += 1
                left, operation, members, first = combined(left, operation, self.folded(members)), c, frozenset(), False
                continue
            first = False
            members |= self.item(c)
        members = combined(left, operation, self.folded(members))
        return Class(EVERY - members if negated else members)

    def folded(self, members: frozenset) -> frozenset:
        return members | {b ^ 32 for b in members if b in UPPER or b in LOWER} if self.flags["i"] else members

    def item(self, c: str) -> frozenset:
        """What one item of a bracket expression, begun by c, holds."""
        if c == "[":
            if self.peek() == ":" and (end := self.text.find(":]", self.at)) >= 0:
                name = self.text[self.at + 1 : end]
                if name.lstrip("^") not in POSIX:
                    raise RegexError(f"unknown class [:{name}:]")
                self.at = end + 2
                self.partial(name[:1] == "^")
                return EVERY - POSIX[name[1:]] if name[:1] == "^" else POSIX[name]
            return self.bracket().members
        if c == "\\":
            e = self.take()
            if e in CLASSES:
                self.partial(e.isupper())
                return CLASSES[e]
            low = self.escape(e)
        else:
            low = c.encode()
        high = low
        if self.peek() == "-" and self.peek(2)[1:] not in ("]", "", "-"):
            self.at += 1
            h = self.take()
            high = self.escape(self.take()) if h == "\\" else h.encode()
        if len(low) > 1 or len(high) > 1:
            raise RegexError("a class of bytes can't hold a character of several bytes")
        if high < low:
            raise RegexError("a class range is reversed")
        return frozenset(range(low[0], high[0] + 1))


def combined(left: frozenset | None, operation: str, right: frozenset) -> frozenset:
    """left operation right; without an operation, right."""
    return right if left is None else {"&": left & right, "-": left - right, "~": left ^ right}[operation]


def character(members: frozenset) -> Group:
    """One UTF-8 character: a byte of members below 128, or a sequence of several."""
    longer = [Concat(tuple(Class(frozenset(range(a, b + 1))) for a, b in x)) for x in UTF8]
    return Group(Alternation((Class(frozenset(b for b in members if b < 128)), *longer)))


def states(node: object) -> int:
    """About how many states an automaton for the tree has."""
    if isinstance(node, Repeat):
        n = states(node.sub)
        return node.least * n + (n + 1 if node.most is None else (node.most - node.least) * (n + 1))
    return len(node.data) if isinstance(node, Literal) else max(1, sum(map(states, children(node))) + isinstance(node, Alternation))


def parse(pattern: str) -> object:
    return Parser(pattern).whole()


def byte(b: int) -> str:
    return chr(b) if b in POSIX["alnum"] or b == 0x20 else f"\\x{b:02x}"


def of_class(members: frozenset) -> str:
    if not members:
        return "(?!)"
    out, run = [], sorted(members)
    i = 0
    while i < len(run):
        j = i
        while j + 1 < len(run) and run[j + 1] == run[j] + 1:
            j += 1
        out.append(byte(run[i]) if i == j else f"{byte(run[i])}-{byte(run[j])}")
        i = j + 1
    return "[" + "".join(out) + "]"


_W = of_class(WORD)
LOOKS = {
    "start": r"\A", "end": r"\z", "line_start": r"(?:\A|(?<=\x0a))", "line_end": r"(?:\z|(?=\x0a))",
    "crlf_start": r"(?:\A|(?<=\x0a)|(?<=\x0d)(?!\x0a))", "crlf_end": r"(?:\z|(?=\x0d)|(?<!\x0d)(?=\x0a))",
    "word_start": f"(?:(?<!{_W})(?={_W}))", "word_end": f"(?:(?<={_W})(?!{_W}))", "word_start_half": f"(?<!{_W})", "word_end_half": f"(?!{_W})",
    "word": f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))", "not_word": f"(?:(?<={_W})(?={_W})|(?<!{_W})(?!{_W}))",
}


def to_java(node: object) -> str:
    """A Java pattern, for text of one character a byte."""
    if isinstance(node, Literal):
        return "".join(map(byte, node.data))
    if isinstance(node, Class):
        return of_class(node.members)
    if isinstance(node, Look):
        return LOOKS[node.kind]
    if isinstance(node, Concat):
        nexts = (*node.parts[1:], None)
        return "".join(f"(?:{to_java(p)})" if isinstance(p, Alternation) else to_java(p) + "+" * gives_nothing_back(p, n) for p, n in zip(node.parts, nexts, strict=False))
    if isinstance(node, Alternation):
        return "|".join(map(to_java, node.parts))
    if isinstance(node, Group):
        return f"(?:{to_java(node.sub)})"
    count = f"{{{node.least},{'' if node.most is None else node.most}}}"
    sub = to_java(node.sub)
    return (sub if isinstance(node.sub, (Class, Group)) or (isinstance(node.sub, Literal) and len(node.sub.data) == 1) else f"(?:{sub})") + count + ("" if node.greedy else "?")


def firsts(node: object) -> frozenset | None:
    """The bytes that a match begins with; None if that isn't known or it may be empty."""
    if isinstance(node, Class):
        return node.members
    if isinstance(node, Literal):
        return frozenset(node.data[:1]) or None
    if isinstance(node, Group) or (isinstance(node, Repeat) and node.least > 0):
        return firsts(node.sub)
    return None


def gives_nothing_back(node: object, follows: object) -> bool:
    """Whether a greedy run of a class is followed by what can't begin in that class: a shorter run never helps, so Java needn't try one."""
    if not (isinstance(node, Repeat) and node.greedy and isinstance(node.sub, Class)):
        return False
    then = firsts(follows)
    return then is not None and not then & node.sub.members


def children(node: object) -> tuple:
    return node.parts if isinstance(node, (Concat, Alternation)) else (node.sub,) if isinstance(node, (Group, Repeat)) else ()


def is_ascii(node: object) -> bool:
    """Whether matching text gives what matching its UTF-8 bytes would: no part of the pattern can meet a byte over 127."""
    if isinstance(node, Literal):
        return node.data.isascii()
    if isinstance(node, Class):
        return max(node.members, default=0) < 128
    return all(map(is_ascii, children(node)))


def nullable(node: object) -> bool:
    if isinstance(node, (Literal, Class)):
        return isinstance(node, Literal) and not node.data
    if isinstance(node, Repeat):
        return node.least == 0 or nullable(node.sub)
    return any(map(nullable, node.parts)) if isinstance(node, Alternation) else all(map(nullable, children(node)))


def required_literal(node: object) -> bytes | None:
    """The longest literal (the first of equals) that every match holds, as far as the tree shows it."""
    if isinstance(node, Class) and len(node.members) == 1:
        return bytes(node.members)
    if isinstance(node, Literal):
        return node.data or None
    if isinstance(node, Group) or (isinstance(node, Repeat) and node.least > 0):
        return required_literal(node.sub)
    if isinstance(node, Concat):
        return max(filter(None, map(required_literal, node.parts)), key=len, default=None)
    if isinstance(node, Alternation):
        found = set(map(required_literal, node.parts))
        return found.pop() if len(found) == 1 else None
    return None


def literal_context(node: object, literal: bytes) -> tuple[str, str] | None:
    """Java patterns of what must stand before and after the literal: neighbour and run of separators, or '' where nothing is known."""

    def inner(n: object, kind: type) -> object | None:
        while isinstance(n, Group) or (isinstance(n, Repeat) and n.least > 0):
            n = n.sub
        return n if isinstance(n, kind) else None

    def pair(near: object | None, far: object | None) -> tuple[str, str] | None:
        a, b = (inner(x, Class) if x is not None else None for x in (near, far))
        known = a and b and {a.members, b.members} <= {WORD, SPACE} and a.members != b.members
        return (of_class(a.members), of_class(b.members)) if known else None

    if isinstance(node, Concat):
        for i, p in enumerate(node.parts):
            if (x := inner(p, Literal)) and x.data == literal:
                before, after = node.parts[:i][::-1] + (None, None), node.parts[i + 1 :] + (None, None)
                left, right = pair(*before[:2]), pair(*after[:2])
                if left or right:
                    return (f"{left[1]}{left[0]}{{1,255}}" if left else "", f"{right[0]}+{right[1]}" if right else "")
    return next(filter(None, (literal_context(c, literal) for c in children(node))), None)
