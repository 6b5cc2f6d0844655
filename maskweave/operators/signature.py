"""What a text may hold: the prefilter of the rules.

A signature has the text's numbers and runs of capitals (``shape``, a short text of its own), and
which of the literals that any rule needs occur (``words``). Two scans by patterns make it: one for the
shapes, and one, in the form of a trie, for all literals that stand alone as words; the
others are sought as bytes in the folded text, which costs far less than a pattern. A rule is tried on a text only where both have
what a match of it needs; both may have more, never less.
"""

from __future__ import annotations

import re
from functools import lru_cache

from ..functions.text import array_of, quoted
from ..plans.rules import Rule

#: Numbers with single blanks or dashes between their digits, and runs of capitals. Nothing follows a loop: possessive, it needs no stack.
SHAPE = r"\p{Nd}(?:[ \-]?\p{Nd})*+|[A-Z]{6,}"


def folded_sql(text: str) -> str:
    """Lower case as patterns that ignore case see it: letters that they take for one become one."""
    return f"lower(upper(replace({text}, 'İ', 'i')))"


def needed(rules: list[Rule], keywords: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    """All literals that some rule needs."""
    return tuple(sorted({w for r in rules for w in (*r.words, *gate_words(r, keywords))}))


def gate_words(r: Rule, keywords: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    """Keywords of which one must stand near a match, those apart that hold another."""
    words = {w.lower() for w in keywords.get(r.type, ())} if r.needs_keyword else set()
    return tuple(sorted(w for w in words if not any(o != w and o in w for o in words)))


@lru_cache(maxsize=64)
def trie(words: tuple[str, ...], end: str = "(?!\\p{L})") -> str:
    """A pattern of words between signs that are no letters (with an empty end: before anything); the sign before is part of the match."""
    root: dict = {}
    for word in words:
        at = root
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(node: dict) -> str:
        ways = [re.escape(c) + pattern(kid) if c else end for c, kid in sorted(node.items(), reverse=True)]
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return f"\\P{{L}}({pattern(root)})"


def _plain(literal: str) -> str:
    return literal.strip("|")


def _holds(words: str, some: tuple[str, ...]) -> str:
    return f"arrays_overlap({words}, {array_of(some)})"


def low_sql(text: str) -> str:
    """The folded text in which literals are sought; a blank before it stands for its start."""
    return f"concat(' ', {folded_sql(text)})"


def signature_sql(text: str, low: str, rules: list[Rule], keywords: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """shape and words of a text, as SQL."""
    literals = needed(rules, keywords)
    alone = tuple(w for w in literals if w.startswith("|"))
    found = ", ".join(f"CASE WHEN contains({low}, {quoted(w)}) THEN {quoted(w)} END" for w in literals if w not in alone)
    parts = [f"filter(array({found}), w -> w IS NOT NULL)"] if found else []
    parts += [f"transform(array_distinct(regexp_extract_all({low}, {quoted(trie(tuple(map(_plain, alone))))}, 1)), w -> concat('|', w, '|'))"] if alone else []
    return {"shape": f"concat_ws('\\n', regexp_extract_all({text}, {quoted(SHAPE)}, 0))" if any(r.shape for r in rules) else "''", "words": f"concat({', '.join(parts)})" if parts else array_of(())}


def tests_sql(r: Rule, text: str, shape: str, words: str, keywords: dict[str, tuple[str, ...]]) -> list[str]:
    """What a text that the rule matches passes, the cheap tests first."""
    tests = [f"{shape} RLIKE {quoted(r.shape)}"] if r.shape else []
    tests += [_holds(words, some) for some in (r.words, gate_words(r, keywords)) if some]
    if r.guard:
        tests.append(f"contains({text}, {quoted(r.guard)})" if re.fullmatch(r"[\w@:/ -]+", r.guard) else f"{text} RLIKE {quoted(r.guard)}")
    return tests


def hits_sql(text: str, shape: str, words: str, rules: list[Rule], keywords: dict[str, tuple[str, ...]], tried: int | None = None) -> str:
    """The numbers of the rules (the first ``tried`` of them) that match in the text, tried where the signature lets them."""
    out = []
    for i, r in enumerate(rules[:tried]):
        tests = tests_sql(r, text, shape, words, keywords)
        out.append(f"CASE WHEN {' AND '.join([*tests, f'{text} RLIKE {quoted(r.pattern)}'])} THEN {i} END")
    return f"filter(array({', '.join(out)}), h -> h IS NOT NULL)" if out else "cast(array() as array<int>)"
