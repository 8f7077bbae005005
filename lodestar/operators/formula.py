"""Model terms: main effects, interactions, group-level terms and smooths.

A term is written as in a model formula: ``x``, ``x:z``, ``(1 | g)``, ``(x | g)``, ``s(x)``. A
candidate may join several with ``+``. Interactions are kept under one canonical order of their parts.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field, replace

SMOOTHS = ("s", "t2")
REJECTED_SMOOTHS = ("te", "ti")


def split_top(text: str, mark: str = "+") -> list[str]:
    """Parts between marks that are outside brackets."""
    parts, depth, now = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == mark and depth == 0:
            parts.append(now.strip())
            now = ""
        else:
            now += c
    return [p for p in [*parts, now.strip()] if p]


def canonical(term: str) -> str:
    """The term without stray blanks, an interaction's parts in order."""
    term = re.sub(r"\s+", " ", term.strip())
    if is_group(term):
        return group_term(*group_parts(term))
    parts = split_top(term, ":")
    return ":".join(sorted(p.strip() for p in parts)) if len(parts) > 1 else term


def is_group(term: str) -> bool:
    return term.startswith("(") and term.endswith(")") and "|" in term


def is_smooth(term: str) -> bool:
    return bool(re.match(rf"({'|'.join(SMOOTHS)})\(", term))


def is_interaction(term: str) -> bool:
    return not is_group(term) and len(split_top(term, ":")) > 1


@dataclass(frozen=True)
class Formula:
    """Responses and terms; ``terms`` are canonical and distinct, in order of appearance."""

    responses: tuple[str, ...]
    terms: tuple[str, ...]
    offsets: tuple[str, ...] = ()
    intercept: bool = True
    blocks: tuple[str, ...] = field(default=())

    def of_kind(self, kind: str) -> list[str]:
        """Terms that are ``individual``, ``interaction``, ``additive`` or ``group``."""
        test = {"group": is_group, "additive": is_smooth, "interaction": is_interaction}
        if kind == "individual":
            return [t for t in self.terms if not any(f(t) for f in test.values())]
        return [t for t in self.terms if test[kind](t)]


def signed_parts(text: str) -> list[tuple[int, str]]:
    """Parts between plus and minus signs outside brackets, with their signs."""
    parts, depth, now, sign = [], 0, "", 1
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth == 0 and c in "+-":
            if now.strip():
                parts.append((sign, now.strip()))
            elif c == "-" and parts and sign == -1:
                raise ValueError(f"two signs in a row: {text}")
            now, sign = "", 1 if c == "+" else -1
        else:
            now += c
    if depth:
        raise ValueError(f"brackets don't match: {text}")
    return [*parts, (sign, now.strip())] if now.strip() else parts


def _joined(left: list[str], right: list[str]) -> list[str]:
    """Interactions of every term of one side with every one of the other; a factor counts once."""
    return [":".join(dict.fromkeys([*split_top(a, ":"), *split_top(b, ":")])) for a in left for b in right]


def expand_product(part: str) -> list[str]:
    """The terms that a part stands for: ``a * b``, ``a / b``, ``(a + b)^2``, ``(a + b):c``; others as they are.

    A power holds all interactions up to that order; ``a / b`` is a and b within all of a.
    """
    part = part.strip()
    if is_group(part) or is_smooth(part):
        return [part]
    if len(factors := split_top(part, "*")) > 1:
        known: list[str] = []
        for f in factors:
            own = expand_product(f)
            known = [*known, *own, *_joined(known, own)] if known else own
        return sorted(dict.fromkeys(known), key=lambda t: len(split_top(t, ":")))
    if len(factors := split_top(part, "/")) > 1:
        outer = expand_product("/".join(factors[:-1]))
        within = ":".join(dict.fromkeys(f for t in outer for f in split_top(t, ":")))
        return [*outer, *_joined([within], expand_product(factors[-1]))]
    if len(factors := split_top(part, ":")) > 1:
        known = expand_product(factors[0])
        for f in factors[1:]:
            known = _joined(known, expand_product(f))
        return list(dict.fromkeys(known))
    if len(factors := split_top(part, "^")) > 1:
        if len(factors) > 2 or not factors[1].isdigit() or int(factors[1]) < 1:
            raise ValueError(f"a power of terms must be a whole number: {part}")
        base, known = expand_product(factors[0]), []
        for n in range(1, int(factors[1]) + 1):
            known += [":".join(dict.fromkeys(f for t in c for f in split_top(t, ":"))) for c in itertools.combinations(base, n)]
        return list(dict.fromkeys(known))
    if part.startswith("(") and part.endswith(")"):
        return expand_sum(part[1:-1])[0]
    return [part]


def expand_sum(text: str) -> tuple[list[str], bool]:
    """Terms of a sum in which later parts can take away earlier ones, and whether it has an intercept."""
    terms, intercept = [], True
    for sign, part in signed_parts(text):
        if part in ("0", "1"):
            intercept = (part == "1") == (sign > 0)
            continue
        own = expand_product(part)
        if sign > 0:
            terms += own
        else:
            gone = {canonical(t) for t in own}
            terms = [t for t in terms if canonical(t) not in gone]
    return list(dict.fromkeys(terms)), intercept


def group_parts(term: str) -> tuple[list[str], str, bool]:
    """Slopes of a group term, its grouping factor, and whether it has an intercept."""
    slope, group = (s.strip() for s in term[1:-1].split("|"))
    slopes, intercept = expand_sum(slope)
    return [canonical(s) for s in slopes], canonical(group), intercept


def group_term(slopes: list[str], group: str, intercept: bool = True) -> str:
    """The term of these slopes: ``(1 | g)``, ``(x | g)``, or ``(0 + x | g)`` without intercept."""
    if not slopes and not intercept:
        raise ValueError(f"a group term of {group} with neither intercept nor slope")
    return f"({'' if intercept else '0 + '}{' + '.join(slopes) or '1'} | {group})"


def parse(text: str, columns: list[str] | None = None) -> Formula:
    """A formula; ``.`` stands for all columns but the responses."""
    left, _, right = text.partition("~")
    if not right:
        left, right = "", left
    left = left.strip()
    inner = left[6:-1] if left.startswith("cbind(") else left
    responses = tuple(r.strip() for r in split_top(inner, ",")) if inner else ()
    if len(responses) > 2:
        raise ValueError("at most two response columns")
    offsets, kept = [], []
    for sign, part in signed_parts(right):
        if part.startswith("offset("):
            if sign > 0:
                offsets.append(part[7:-1].strip())
            elif (inner := part[7:-1].strip()) in offsets:
                offsets.remove(inner)
        else:
            others = [c for c in columns or [] if c not in responses]
            kept += [(sign, c) for c in others] if part == "." else [(sign, part)]
    terms, intercept = expand_sum(" ".join(f"{'+' if sign > 0 else '-'} {part}" for sign, part in kept))
    for t in terms:
        if is_group(t) and "(" in t[1:-1].split("|")[1]:
            raise ValueError(f"function calls behind the bar: {t}")
        if re.match(rf"({'|'.join(REJECTED_SMOOTHS)})\(", t) or is_smooth(t) and ("=" in t and "by" not in t):
            raise ValueError(f"unsupported smooth: {t}")
    return Formula(responses, tuple(flatten(terms)), tuple(offsets), intercept)


def flatten(terms: list[str]) -> list[str]:
    """Distinct terms, group terms merged by grouping factor (with an intercept if one of them has it), and no linear term of a smooth that is there."""
    plain = list(dict.fromkeys(canonical(t) for t in terms if not is_group(canonical(t))))
    smooth = {a.strip() for t in plain if is_smooth(t) for a in split_top(t[t.index("(") + 1 : -1], ",") if "=" not in a}
    plain = [t for t in plain if t not in smooth or is_smooth(t)]
    groups: dict[str, tuple[list[str], bool]] = {}
    for t in terms:
        if is_group(t):
            slopes, group, intercept = group_parts(t)
            known, had = groups.get(group, ([], False))
            groups[group] = ([*known, *slopes], had or intercept)
    return plain + [group_term(list(dict.fromkeys(s)), g, i) for g, (s, i) in groups.items()]


def lower_orders(term: str) -> list[str]:
    """An interaction's parts, their interactions and itself, by order."""
    parts = split_top(term, ":")
    return [canonical(":".join(c)) for n in range(1, len(parts) + 1) for c in itertools.combinations(parts, n)]


def smooth_by(term: str) -> str | None:
    """The variable of a smooth's ``by`` argument."""
    for argument in split_top(term[term.index("(") + 1 : -1], ","):
        name, _, value = argument.partition("=")
        if value and name.strip() == "by":
            return value.strip()
    return None


def split_smooth(term: str, factors: list[str]) -> list[str]:
    """A smooth for each level of a factor needs the factor's own effect, which is also a block of its own."""
    by = smooth_by(term)
    return [by, f"{by} + {term}"] if by in factors else [term]


def break_matrix_terms(formula: Formula, columns_of: dict[str, list[str]]) -> Formula:
    """The formula with every main effect that stands for several columns replaced by those, each a term of its own."""
    terms = [c for t in formula.terms for c in (columns_of.get(t, [t]) if not (is_group(t) or is_interaction(t) or is_smooth(t)) else [t])]
    return replace(formula, terms=tuple(flatten(terms)))


def split_blocks(formula: Formula, lower: bool = True, factors: list[str] | None = None) -> list[str]:
    """Candidate blocks of a search: each term with what it needs, the intercept first; ``factors`` names factor columns."""
    with_lower = lambda t: lower_orders(t) if lower and is_interaction(t) else [t]
    blocks = ["1", *formula.of_kind("individual"), *[b for t in formula.of_kind("additive") for b in split_smooth(t, factors or [])]]
    blocks += [" + ".join(with_lower(t)) for t in formula.of_kind("interaction")]
    for t in formula.of_kind("group"):
        slopes, group, intercept = group_parts(t)
        if intercept:
            blocks.append(f"(1 | {group})")
        for s in slopes:
            main = " + ".join(with_lower(s))
            own = f"({'' if intercept else '0 + '}{main} | {group})"
            blocks += ([f"{main} + {own}"] if lower else [own]) + ([f"{main} + (1 | {group})"] if intercept and lower else [])
    return list(dict.fromkeys(blocks))


def size(terms: list[str]) -> int:
    """Number of terms with the intercept; a group term counts its intercept and every slope."""
    n = 1
    for t in flatten([p for t in terms for q in split_top(t) for p in expand_product(q) if p != "1"]):
        if is_group(t):
            slopes, _, intercept = group_parts(t)
            n += len(slopes) + intercept
        else:
            n += 1
    return n


def candidates(chosen: list[str], blocks: list[str], wanted: int) -> list[list[str]]:
    """What can be added to ``chosen`` to make exactly ``wanted`` terms, redundant additions left out.

    May be empty; a search skips that size then.
    """
    have = flatten([p for t in chosen for q in split_top(t) for p in expand_product(q) if p != "1"])
    found: dict[frozenset, list[str]] = {}
    for block in blocks:
        parts = [p for q in split_top(block) for p in expand_product(q) if p != "1"]
        both = flatten([*have, *parts])
        if size(both) == wanted and frozenset(both) != frozenset(have):
            found.setdefault(frozenset(both), [t for t in both if t not in have])
    return list(found.values())


def forced_terms(forced: list[str], optional: list[str]) -> list[str]:
    """Blocks by which the forced terms enter before any optional one."""
    base = " + ".join(forced)
    return [base, *[f"{base} + {o}" for o in optional]]


def ranked_terms(columns: list[str], term_of: dict[str, str]) -> list[str]:
    """Ranked columns as ranked terms: a term enters with the first of its columns."""
    return list(dict.fromkeys(term_of.get(c, c) for c in columns))


def lower_first(ranking: list[str]) -> tuple[list[str], bool]:
    """The ranking with every interaction behind its lower orders, and whether that moved anything."""
    out: list[str] = []
    for t in ranking:
        for need in lower_orders(t) if is_interaction(t) else [t]:
            if need in ranking and need not in out:
                out.append(need)
    return out, out != ranking
