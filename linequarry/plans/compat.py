"""A grep-like command line, lowered to the predicate language."""

from __future__ import annotations

from dataclasses import dataclass, field

NATIVE = ("lit:", "re:", "prefix:", "suffix:")
#: What a regular expression's escape puts a backslash before.
META = frozenset("\\.+*?()|[]{}^$#&-~")
SUPPORTED = "PATTERN [PATH]..., -e/--regexp, -F/--fixed-strings, -i/--ignore-case, -j/--threads, -n/--line-number, --json and --hidden"


class CompatError(ValueError):
    """The request can't be lowered."""


@dataclass
class Request:
    expression: str
    paths: list[str]
    json: bool = False
    hidden: bool = False
    threads: int | None = None
    flags: dict = field(default_factory=dict)


def is_native(pattern: str) -> bool:
    p = pattern.strip()
    return "&&" in p or "||" in p or p.startswith(NATIVE)


def escaped(pattern: str) -> str:
    return "".join("\\" + c if c in META else c for c in pattern)


def lower_patterns(patterns: list[str], fixed_strings: bool = False, ignore_case: bool = False) -> str:
    """One expression for any of the patterns."""
    if not patterns:
        raise CompatError("at least one pattern is needed")
    if len(patterns) == 1 and is_native(patterns[0]):
        if fixed_strings or ignore_case:
            raise CompatError("a native expression can't be combined with -F or -i")
        return patterns[0].strip()
    if any(not p.strip() for p in patterns):
        raise CompatError("patterns may not be empty")
    if not fixed_strings and any("&&" in p or "||" in p for p in patterns):
        raise CompatError("patterns with && or || are ambiguous with the expression's own operators")

    def one(p: str) -> str:
        fold = "(?i)" if ignore_case else ""
        if not fixed_strings:
            return f"re:{fold}{p}"
        return f"re:{fold}{escaped(p)}" if fold or "&&" in p or "||" in p else f"lit:{p}"

    return " || ".join(map(one, patterns))


def lower_grep(argv: list[str]) -> Request:
    """A command line to a request; -n is accepted and means nothing."""
    patterns, rest, fixed, fold, out = [], [], False, False, Request("", ["."])
    args = list(argv)
    while args:
        a = args.pop(0)
        if a == "--":
            rest += args
            break
        if a in ("-e", "--regexp", "-j", "--threads"):
            if not args:
                raise CompatError(f"{a} needs a value")
            a = ("--regexp=" if a in ("-e", "--regexp") else "--threads=") + args.pop(0)
        elif a.startswith("-e") or (a.startswith("-j") and a != "-j"):
            a = ("--regexp=" if a[1] == "e" else "--threads=") + a[2:]
        if a.startswith("--regexp="):
            patterns.append(a[9:])
        elif a.startswith("--threads="):
            if not a[10:].isdecimal():
                raise CompatError("--threads takes a number")
            out.threads = int(a[10:])
        elif a in ("-F", "--fixed-strings"):
            fixed = True
        elif a in ("-i", "--ignore-case"):
            fold = True
        elif a in ("-n", "--line-number"):
            out.flags["line_number"] = True
        elif a == "--json":
            out.json = True
        elif a == "--hidden":
            out.hidden = True
        elif a.startswith("-") and a != "-":
            raise CompatError(f"{a} is not supported; supported are {SUPPORTED}")
        else:
            rest.append(a)
    if not patterns:
        if not rest:
            raise CompatError("expected PATTERN [PATH]... or -e PATTERN [PATH]...")
        patterns, rest = rest[:1], rest[1:]
    out.expression, out.paths = lower_patterns(patterns, fixed, fold), rest or ["."]
    return out
