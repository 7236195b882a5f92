"""The query-string language: `+must -not "a phrase" field:value name:[1 TO 5} (a OR b) AND c wild*`."""

from __future__ import annotations

import re


class BadQuery(ValueError):
    """A query string that can't be parsed."""


_TOKEN = re.compile(
    r"""\s*(?:(?P<and>AND\b|&&)|(?P<or>OR\b|\|\|)|(?P<not>NOT\b|!)|(?P<open>\()|(?P<close>\))|(?P<plus>\+)|(?P<minus>-)
    |(?P<field>[A-Za-z_][\w.]*):(?=\S)|(?P<range>[\[{][^\]}]*[\]}])|(?P<phrase>"(?:[^"\\]|\\.)*")
    |(?P<cmp>[<>]=?[^\s()]+)|(?P<regex>/(?:[^/\\]|\\.)+/)|(?P<word>(?:[^\s()"\[\]{}:\\]|\\.)+))""",
    re.X,
)


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise BadQuery(f"can't parse {text!r} from {at}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def parse(text: str, fields: list[str], default_operator: str = "or") -> dict:
    """A tree of the query hashes that requests are made of."""
    items, at = _tokens(text), 0
    both = default_operator.lower() == "and"

    def peek() -> str | None:
        return items[at][0] if at < len(items) else None

    def leaf(kind: str, value: str, on: list[str]) -> dict:
        if kind == "word" and value == "*":
            return {"match_all": {}} if on == fields else {"exists": {"field": on[0]}}
        many = []
        for f in on:
            if kind == "phrase":
                many.append({"match_phrase": {f: re.sub(r"\\(.)", r"\1", value[1:-1])}})
            elif kind == "regex":
                many.append({"regexp": {f: value[1:-1]}})
            elif kind == "range":
                m = re.fullmatch(r"([\[{])\s*(\S+)\s+TO\s+(\S+)\s*([\]}])", value)
                if not m:
                    raise BadQuery(f"not a range: {value}")
                low = {} if m[2] == "*" else {"gte" if m[1] == "[" else "gt": m[2]}
                many.append({"range": {f: {**low, **({} if m[3] == "*" else {"lte" if m[4] == "]" else "lt": m[3]})}}})
            elif kind == "cmp":
                m = re.match(r"([<>]=?)(.+)", value)
                many.append({"range": {f: {{">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}[m[1]]: m[2]}}})
            elif fuzzy := re.fullmatch(r"(.+)~(\d?)", value):
                many.append({"fuzzy": {f: {"value": fuzzy[1].lower(), "fuzziness": int(fuzzy[2] or 2)}}})
            elif re.search(r"(?<!\\)[*?]", value):
                many.append({"wildcard": {f: {"value": value.lower(), "case_insensitive": True}}})
            else:
                many.append({"match": {f: {"query": re.sub(r"\\(.)", r"\1", value), "operator": default_operator}}})
        return many[0] if len(many) == 1 else {"dis_max": {"queries": many}}

    def one(on: list[str]) -> dict:
        nonlocal at
        kind = peek()
        if kind is None:
            raise BadQuery("something is missing at the end")
        value = items[at][1]
        at += 1
        if kind == "open":
            inner = several(on)
            if peek() != "close":
                raise BadQuery("a bracket isn't closed")
            at += 1
            return inner
        if kind == "field":
            return {"exists": {"field": items[at - 1 + 1][1]}} if value == "_exists_" and _skip() else one([value])
        if kind in ("word", "phrase", "range", "cmp", "regex"):
            return leaf(kind, value, on)
        raise BadQuery(f"unexpected {value!r}")

    def _skip() -> bool:
        nonlocal at
        at += 1
        return True

    def several(on: list[str]) -> dict:
        nonlocal at
        clauses: list[tuple[str, dict]] = []
        joined = None
        while peek() not in (None, "close"):
            kind = peek()
            if kind in ("and", "or"):
                if not clauses or joined:
                    raise BadQuery("an operator without a left side")
                joined, at = kind, at + 1
                continue
            how = None
            while peek() in ("not", "minus", "plus"):
                how = "must" if peek() == "plus" else "must_not" if how != "must_not" else None
                at += 1
            if joined == "and" and clauses[-1][0] == "should":
                clauses[-1] = ("must", clauses[-1][1])
            if joined == "or" and clauses[-1][0] == "must" and both:
                clauses[-1] = ("should", clauses[-1][1])
            how = how or ("must" if joined == "and" or (both and joined != "or") else "should")
            clauses.append((how, one(on)))
            joined = None
        if joined:
            raise BadQuery("an operator without a right side")
        if not clauses:
            raise BadQuery("an empty query")
        if len(clauses) == 1 and clauses[0][0] != "must_not":
            return clauses[0][1]
        out: dict[str, list] = {}
        for how, q in clauses:
            out.setdefault(how, []).append(q)
        return {"bool": out}

    tree = several(fields)
    if at < len(items):
        raise BadQuery("a bracket is closed that wasn't opened")
    return tree
