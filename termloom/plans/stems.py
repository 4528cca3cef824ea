"""Porter's stems as SQL, to compare the stemmer with: the same steps, told by patterns over whole words."""

from __future__ import annotations

from termloom.functions.porter import STEP2, STEP3, STEP4

# A word begins with consonants or not, then vowels and consonants take turns; y is a vowel after a consonant. A y at the
# beginning is a consonant and written Y meanwhile.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _some(x: str) -> str:
    """One turn at least."""
    return _has(x, f"^(?:{_C})?{_V}{_C}")


def _many(x: str) -> str:
    """Two turns at least."""
    return _has(x, f"^(?:{_C})?{_V}{_C}{_V}{_C}")


def _once(x: str) -> str:
    return _has(x, f"^(?:{_C})?{_V}{_C}(?:{_V})?$")


def _vowel(x: str) -> str:
    return _has(x, f"^(?:{_C})?[aeiouy]")


def _cut(n: int) -> str:
    return f"w[:len(w) - {n}]"


def _ending(names) -> str:
    return f"regexp_extract(w, '({'|'.join(sorted(names, key=len, reverse=True))})$', 1)"


def _swap(pairs: list[tuple[str, str]]) -> str:
    """The ending e of a word whose rest has a turn becomes another."""
    to = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in pairs) + "}"
    return f"CASE WHEN e <> '' AND {_some('w[:len(w) - len(e)]')} THEN w[:len(w) - len(e)] || {to}[e] ELSE w END"


def stems_sql(rel: str) -> str:
    """(term, stem) of a relation (term) of distinct terms."""
    r = f"SELECT term, lower(term) AS w, regexp_matches(lower(term), '^[a-z]{{3,}}$') AS ok FROM ({rel})"
    r = f"SELECT term, ok, CASE WHEN ok AND w[1] = 'y' THEN 'Y' || w[2:] ELSE w END AS w FROM ({r})"
    step = lambda e: f"SELECT term, ok, CASE WHEN ok THEN {e} ELSE w END AS w FROM ({r})"
    r = step(f"CASE WHEN {_has('w', '(sses|ies)$')} THEN {_cut(2)} WHEN {_has('w', 's$')} AND NOT {_has('w', 'ss$')} THEN {_cut(1)} ELSE w END")
    tidy = lambda x: f"CASE WHEN {_has(x, '(at|bl|iz)$')} THEN {x} || 'e' WHEN len({x}) > 1 AND {x}[-1] = {x}[-2] AND {_has(x, '[^aeioulsz]$')} THEN {x}[:len({x}) - 1] WHEN {_once(x)} AND {_has(x, _SHORT)} THEN {x} || 'e' ELSE {x} END"
    r = step(f"CASE WHEN {_has('w', 'eed$')} THEN CASE WHEN {_some(_cut(3))} THEN {_cut(1)} ELSE w END WHEN {_has('w', 'ed$')} AND {_vowel(_cut(2))} THEN {tidy(f'({_cut(2)})')} WHEN {_has('w', 'ing$')} AND {_vowel(_cut(3))} THEN {tidy(f'({_cut(3)})')} ELSE w END")
    r = step(f"CASE WHEN {_has('w', '[yY]$')} AND {_vowel(_cut(1))} THEN {_cut(1)} || 'i' ELSE w END")
    for pairs in (STEP2, STEP3):
        r = f"SELECT term, ok, CASE WHEN ok THEN {_swap(pairs)} ELSE w END AS w FROM (SELECT *, {_ending([a for a, _ in pairs])} AS e FROM ({r}))"
    rest = "w[:len(w) - len(e)]"
    r = f"SELECT term, ok, CASE WHEN ok AND e <> '' AND {_many(rest)} AND (e <> 'ion' OR {_has(rest, '[st]$')}) THEN {rest} ELSE w END AS w FROM (SELECT *, {_ending(STEP4)} AS e FROM ({r}))"
    r = step(f"CASE WHEN {_has('w', 'e$')} AND ({_many(_cut(1))} OR {_once(_cut(1))} AND NOT {_has(_cut(1), _SHORT)}) THEN {_cut(1)} ELSE w END")
    r = step(f"CASE WHEN {_has('w', 'll$')} AND {_many('w')} THEN {_cut(1)} ELSE w END")
    return f"SELECT term, lower(w) AS stem FROM ({r})"
