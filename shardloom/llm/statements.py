"""The canonical form of a data statement: what is left when formatting is taken away.

Statements have the same form if they have the same verb, table, fields, values, conditions and closing clause, and
differ at most in white space between words and signs, letter case, marks without meaning (back quotes, the kind of
quotes, semicolons, brackets around a condition) and the order of listed fields, assignments, column-value pairs or
conditions joined by the same word. Conditions are those of WHERE, ON and HAVING, of queries in brackets, too, and
those under a NOT. The order of fields counts where places give it a meaning: in queries in brackets and in a UNION.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_QUOTED = r"""[xbn]?'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`[^`]*`"""
_TOKEN = re.compile(rf"{_QUOTED}|[^\W\d][\w$]*|\d+(?:\.\d+)?(?:e[+-]?\d+)?[\w$]*|[<>=!]+|\S", re.DOTALL)
#: The same for ASCII, what is most frequent first.
_ASCII_TOKEN = re.compile(
    rf"[a-z_][a-z0-9_$]*+(?!')|[(),.*-]|[0-9]+(?:\.[0-9]+)?(?:e[+-]?[0-9]+)?[a-z0-9_$]*|{_QUOTED}|[<>=!]+|[a-z_][a-z0-9_$]*|\S", re.DOTALL | re.ASCII
)
#: Words that begin the closing clause.
_CLOSING = frozenset(("group", "having", "order", "limit", "for", "lock", "into", "procedure"))
#: Words that are looked for outside brackets.
_MARKS = _CLOSING | {"from", "where", "set", "on", "values", "value", "union", "as", "select"}
#: Words that join conditions, the loosest first.
_JOINING = ("or", "xor", "and")
#: What makes a condition more than terms joined by one word.
_COMPOUND = frozenset(("(", "between", "case", "not", "or", "xor"))
#: Words between SELECT and its fields.
_PREFIXES = frozenset(("distinct", "distinctrow", "all", "high_priority", "straight_join", "sql_no_cache", "sql_cache", "sql_calc_found_rows"))
_JOINS = frozenset((",", "join", "left", "right", "inner", "cross", "straight_join", "natural", "on"))
_GAP = "\x1f"
_AND, _COMMA = f"{_GAP}and{_GAP}", f"{_GAP},{_GAP}"


def tokens(text: str) -> list[str]:
    """Words, numbers, signs and quoted values in lower case. Quoted values keep their blanks and get one kind of quotes."""
    found = (_ASCII_TOKEN if text.isascii() else _TOKEN).findall(text.lower())
    if '"' not in text and "`" not in text and ";" not in text:
        return found
    out = []
    for t in found:
        c = t[0]
        if c == "`" and len(t) > 1:
            t = t[1:-1]
        elif c == '"' and len(t) > 1:
            t = "'" + t[1:-1].replace('""', '"').replace("'", "''") + "'"
        elif c == ";":
            continue
        out.append(t)
    return out


def _split(ts: list[str], sign: str) -> list[list[str]]:
    """Cuts at a sign outside brackets and CASE; the AND of a BETWEEN is no cut."""
    if sign not in ts:
        return [ts]
    parts, part, depth, cases, between = [], [], 0, 0, False
    for t in ts:
        if t == "(":
            depth += 1
        elif t == ")":
            depth -= 1
        elif t == "case":
            depth, cases = depth + 1, cases + 1
        elif t == "end" and cases:
            depth, cases = depth - 1, cases - 1
        elif depth == 0:
            if t == "between":
                between = True
            elif t == sign:
                if between and sign == "and":
                    between = False
                else:
                    parts.append(part)
                    part = []
                    continue
        part.append(t)
    parts.append(part)
    return parts


def _bare(ts: list[str]) -> list[str]:
    """Without brackets that enclose all of it."""
    n, left, right = len(ts), 0, 0
    while left < n and ts[left] == "(":
        left += 1
    while right < n - left and ts[n - 1 - right] == ")":
        right += 1
    if not left or not right:
        return ts
    depth = least = left
    for t in ts[left : n - right]:
        depth += (t == "(") - (t == ")")
        least = min(least, depth)
    most = min(least, right - depth + least)
    return ts[most : n - most] if 0 < most and 2 * most < n else ts


def _joined(ts: list[str]) -> tuple[str, list[list[str]]]:
    """The loosest word that joins a condition, and the terms between."""
    for word in _JOINING:
        parts = _split(ts, word)
        if len(parts) > 1:
            return word, parts
    return "", [ts]


def _term(ts: list[str]) -> str:
    """A condition that nothing joins."""
    if ts and ts[0] == "not" and len(ts) > 1:
        return f"not{_GAP}(" + condition(ts[1:]) + ")"
    return _GAP.join(ts)


def _terms(parts: list[list[str]], word: str) -> list[str]:
    """Texts of terms joined by ``word``, those of bracketed groups of the same word among them."""
    out = []
    for part in parts:
        part = _bare(part)
        inner, within = _joined(part)
        if not inner:
            out.append(_term(part))
        elif inner == word:
            out += _terms(within, word)
        else:
            out.append("(" + condition(part) + ")")
    return out


def condition(ts: list[str]) -> str:
    """Canonical text of a condition: brackets only where words mix, terms of one word in sorted order."""
    if _COMPOUND.isdisjoint(ts):
        return _AND.join(sorted(_GAP.join(ts).split(_AND)))
    ts = _bare(ts)
    word, parts = _joined(ts)
    return f"{_GAP}{word or 'and'}{_GAP}".join(sorted(_terms(parts, word)))


def _listed(ts: list[str]) -> str:
    if "(" in ts:
        return ",".join(sorted(_GAP.join(p) for p in _split(ts, ",")))
    return ",".join(sorted(_GAP.join(ts).split(_COMMA)))


def _marks(ts: list[str]) -> list[tuple[int, str]]:
    """Places of the words that divide a statement, outside brackets."""
    found = [(i, t) for i, t in enumerate(ts) if t in _MARKS]
    if "(" not in ts:
        return found
    out, depth, at = [], 0, 0
    for i, t in found:
        span = ts[at:i]
        depth += span.count("(") - span.count(")")
        at = i
        if depth == 0:
            out.append((i, t))
    return out


def _first(marks: list[tuple[int, str]], start: int, end: int, words: frozenset[str] | tuple[str, ...]) -> int:
    """First place from ``start`` of one of the words, or the end."""
    for i, t in marks:
        if i >= start and t in words:
            return i
    return end


_ENDS = _CLOSING | {"where"}


def _tail(ts: list[str], start: int, marks: list[tuple[int, str]]) -> str:
    """Canonical text of WHERE and the closing clause, from place ``start``."""
    n = len(ts)
    if start >= n:
        return ""
    where = ""
    if ts[start] == "where":
        end = _first(marks, start + 1, n, _CLOSING)
        where, start = "where " + condition(ts[start + 1 : end]), end
    having = _first(marks, start, n, ("having",))
    if having < n:
        end = _first(marks, having + 1, n, _CLOSING)
        return f"{where}|{_GAP.join(ts[start:having])} having {condition(ts[having + 1 : end])} {_GAP.join(ts[end:])}"
    return where + "|" + _GAP.join(ts[start:])


def _tables(ts: list[str]) -> str:
    """Canonical text of the tables of a query: conditions of joins are conditions."""
    if "on" not in ts:
        return _GAP.join(ts)
    out, at, depth = [], 0, 0
    while at < len(ts):
        t = ts[at]
        depth += (t == "(") - (t == ")")
        out.append(t)
        at += 1
        if t == "on" and depth == 0:
            end, inner = at, 0
            while end < len(ts) and not (inner == 0 and ts[end] in _JOINS):
                inner += (ts[end] == "(") - (ts[end] == ")")
                end += 1
            out.append(condition(ts[at:end]))
            at = end
    return _GAP.join(out)


def _fold(ts: list[str]) -> list[str]:
    """Queries in brackets become one token each."""
    out: list[str] = []
    i, n = 0, len(ts)
    while i < n:
        if ts[i] == "(" and i + 1 < n and ts[i + 1] == "select":
            depth, j = 1, i + 1
            while j < n and depth:
                depth += (ts[j] == "(") - (ts[j] == ")")
                j += 1
            if depth:
                return ts
            out += ["(", _query(_fold(ts[i + 1 : j - 1]), False), ")"]
            i = j
        else:
            out.append(ts[i])
            i += 1
    return out


def _query(ts: list[str], unordered: bool) -> str:
    """SELECT, or several joined by UNION; ``unordered``: whether the order of fields has no meaning."""
    if "union" in ts:
        parts = _split(ts, "union")
        if len(parts) > 1:
            return "union".join(_one_select(p, False) if p[:1] == ["select"] else p[0] + " " + _one_select(p[1:], False) if p[1:2] == ["select"] else _GAP.join(p) for p in parts if p)
    return _one_select(ts, unordered)


def _one_select(ts: list[str], unordered: bool) -> str:
    marks, n = _marks(ts), len(ts)
    frm = _first(marks, 1, n, ("from",))
    after = _first(marks, frm, n, _ENDS)
    at = 1
    while at < frm and ts[at] in _PREFIXES:
        at += 1
    fields = _listed(ts[at:frm]) if unordered else _GAP.join(ts[at:frm])
    return f"{_GAP.join(ts[:at])} {fields} {_tables(ts[frm:after])}|{_tail(ts, after, marks)}"


def _select(ts: list[str]) -> str:
    return _query(ts, True)


def _update(ts: list[str]) -> str | None:
    marks, n = _marks(ts), len(ts)
    at = _first(marks, 1, n, ("set",))
    after = _first(marks, at, n, _ENDS)
    if at == n:
        return None
    return f"{_tables(ts[:at])} set {_listed(ts[at + 1 : after])}|{_tail(ts, after, marks)}"


def _delete(ts: list[str]) -> str:
    marks = _marks(ts)
    after = _first(marks, 1, len(ts), _ENDS)
    return f"{_tables(ts[:after])}|{_tail(ts, after, marks)}"


def _duplicate(ts: list[str]) -> str:
    """What follows the rows of an INSERT: an alias, or ON DUPLICATE KEY UPDATE with its assignments."""
    if "update" not in ts:
        return _GAP.join(ts)
    at = ts.index("update")
    return f"{_GAP.join(ts[: at + 1])} {_listed(ts[at + 1 :])}"


def _pairs(columns: list[str], values: list[str]) -> str:
    return ",".join(sorted([f"{c}={v}" for c, v in zip(columns, values, strict=True)]))


def _insert(ts: list[str]) -> str | None:
    n = len(ts)
    if "(" not in ts or "set" in ts[: ts.index("(")]:
        marks = _marks(ts)
        at = _first(marks, 1, n, ("set",))
        if at == n:
            return None
        after = _first(marks, at, n, ("on",))
        return f"{_GAP.join(ts[:at])} set {_listed(ts[at + 1 : after])}|{_duplicate(ts[after:])}"
    opens = ts.index("(")
    closes = ts.index(")", opens) if ")" in ts[opens:] else n
    if closes + 1 >= n or "(" in ts[opens + 1 : closes]:
        return None
    head, columns = _GAP.join(ts[:opens]), _GAP.join(ts[opens + 1 : closes]).split(_COMMA)
    verb = ts[closes + 1]
    if verb == "select":
        return _insert_select(head, columns, ts[closes + 1 :])
    if verb not in ("values", "value") or closes + 2 >= n:
        return None
    marks = _marks(ts)
    after = _first(marks, closes + 2, n, ("on", "as"))
    body = ts[closes + 2 : after]
    rows = []
    for row in [body] if body.count("(") == 1 else _split(body, ","):
        if len(row) < 2 or row[0] != "(" or row[-1] != ")":
            return None
        inner = row[1:-1]
        values = _GAP.join(inner).split(_COMMA) if "(" not in inner else [_GAP.join(v) for v in _split(inner, ",")]
        if len(values) != len(columns):
            return None
        rows.append(_pairs(columns, values))
    return f"{head} pairs {';'.join(rows)}|{_duplicate(ts[after:])}"


def _insert_select(head: str, columns: list[str], ts: list[str]) -> str | None:
    """INSERT .. SELECT: each column goes with the field in its place."""
    marks, n = _marks(ts), len(ts)
    frm = _first(marks, 1, n, ("from", "union"))
    fields = [_GAP.join(v) for v in _split(ts[1:frm], ",")]
    if (frm < n and ts[frm] == "union") or len(fields) != len(columns) or ts[1] in _PREFIXES or any(f.endswith("*") for f in fields) or "union" in ts:
        return None
    after = _first(marks, frm, n, _ENDS | {"on"} if "join" not in ts else _ENDS)
    return f"{head} select {_pairs(columns, fields)} {_tables(ts[frm:after])}|{_tail(ts, after, marks)}"


#: What the short way does not take: brackets and words whose conditions may nest.
_NESTING = _COMPOUND | {"on", "having", "union"}
_WHERE, _FROM, _SET = (f"{_GAP}{w}{_GAP}" for w in ("where", "from", "set"))
_PLAIN_CLOSING = _CLOSING - {"having"}
_CLOSING_MARKS = {w: f"{_GAP}{w}{_GAP}" for w in _PLAIN_CLOSING}
_NOTED = _NESTING | _CLOSING
_OPEN, _CLOSE, _VALUES = f"{_GAP}({_GAP}", f"{_GAP}){_GAP}", f"values{_GAP}({_GAP}"


def _short(s: str, ts: list[str]) -> str | None:
    """The form of a statement without nesting, cut out of its joined tokens; the same text as the long way gives."""
    verb = ts[0]
    if verb in ("insert", "replace"):
        # One row for one list of columns, and nothing after it.
        opens = s.find(_OPEN)
        closes = s.find(_CLOSE, opens)
        if not 0 < opens < closes or not s.startswith(_VALUES, closes + 3) or s.count(_OPEN) != 2 or ts[-1] != ")" or s.find(_CLOSE, closes + 3) >= 0 or s.find(_SET, 0, opens) >= 0:
            return None
        columns, values = s[opens + 3 : closes].split(_COMMA), s[closes + 3 + len(_VALUES) : -2].split(_COMMA)
        return f"{s[:opens]} pairs {_pairs(columns, values)}|" if len(columns) == len(values) else None
    there = _NOTED.intersection(ts)
    if not there <= _PLAIN_CLOSING or ts[-1] in _MARKS:
        return None
    if verb == "delete":
        begin = head = len(verb)
    else:
        begin = s.find(_FROM if verb == "select" else _SET)
        head = begin + 5
        if begin < 0 or ts[1] in _PREFIXES:
            return None
    close = len(s)
    for word in there:
        at = s.find(_CLOSING_MARKS[word], begin, close + 1)
        if at >= 0:
            close = at
    where = s.find(_WHERE, begin, close + 1)
    end, tail = (close, "" if close == len(s) else "|" + s[close + 1 :]) if where < 0 else (where, f"where {_AND.join(sorted(s[where + 7 : close].split(_AND)))}|{s[close + 1 :]}")
    if verb == "delete":
        return f"{s[:end]}|{tail}"
    if verb == "update":
        return f"{s[:begin]} set {','.join(sorted(s[head:end].split(_COMMA)))}|{tail}"
    return f"select {','.join(sorted(s[7:begin].split(_COMMA)))} {s[begin + 1 : end]}|{tail}"


_FORMS = {"select": _select, "update": _update, "delete": _delete, "insert": _insert, "replace": _insert}


def canonical(text: str) -> str:
    """The canonical form. A statement of another shape, or nested too deeply, is its words and signs in their order; empty text is ''."""
    ts = tokens(text)
    if not ts:
        return ""
    form = _FORMS.get(ts[0])
    if form is None:
        return _GAP.join(ts)
    joined = _GAP.join(ts)
    short = _short(joined, ts)
    return short if short is not None else _long(form, ts, joined)


def _long(form: Callable[[list[str]], str | None], ts: list[str], joined: str) -> str:
    """The form of any statement."""
    try:
        if "select" in ts[1:]:
            ts = _fold(ts)
        return form(ts) or joined
    except RecursionError:  # brackets nested hundreds deep
        return joined
