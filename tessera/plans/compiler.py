"""Queries as hashes to column expressions: a predicate, and a score.

Predicates are two-valued: a document without the field doesn't match. A plain leaf may be null for it, which a filter
drops, so that it can be pushed down to the scan; wherever a null would matter (negation, counting, disjunction) it is
turned into false.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geo
from tessera.functions.analysis import REGISTRY, Analyzer, python_tokens
from tessera.functions.scoring import TextStats, bm25
from tessera.plans.clauses import as_list
from tessera.plans.querystring import BadQuery, parse

ONE, ZERO = 1.0, 0.0


@dataclass
class Part:
    """A compiled query. `sure`: the predicate is never null."""

    test: Column
    score: Column
    sure: bool = False

    def certain(self) -> Column:
        return self.test if self.sure else F.coalesce(self.test, F.lit(False))


def every(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def total(scores: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, scores) if scores else F.lit(0.0)


def least_matches(spec: Any, n: int) -> int:
    """Of n optional queries, how many have to match: 2, -1, '75%', '-25%', '2<75%' (several, separated by blanks)."""
    if spec is None:
        return 0
    if isinstance(spec, int):
        out = spec if spec >= 0 else n + spec
    else:
        s = str(spec).strip()
        if "<" in s:
            out = n
            for rule in s.split():
                low, then = rule.split("<")
                if n > int(low):
                    out = least_matches(then, n)
        elif s.endswith("%"):
            share = float(s[:-1])
            out = math.floor(n * share / 100) if share >= 0 else n - math.floor(n * -share / 100)
        else:
            return least_matches(int(s), n)
    return max(0, min(out, n))


@dataclass
class Schema:
    """What a query needs to know of an index."""

    fields: T.StructType
    id_column: str = "_id"
    analyzers: Mapping[str, str] = field(default_factory=dict)  # text field -> analyzer; others aren't analysed
    search_analyzers: Mapping[str, str] = field(default_factory=dict)
    aliases: Mapping[str, str] = field(default_factory=dict)  # multi-field -> the column that holds it
    nested: frozenset[str] = frozenset()
    settings: Mapping | None = None
    name: str = ""
    related: Callable[[str, Mapping], DataFrame] | None = None  # (kind, body) -> ids of a parent/child query
    stored: Mapping[str, str] = field(default_factory=dict)  # text field -> the column that holds its tokens

    def analyzer(self, path: str, searching: bool = False) -> Analyzer | None:
        name = (self.search_analyzers.get(path) if searching else None) or self.analyzers.get(path)
        return REGISTRY.resolve(name, self.settings) if name else None

    def column(self, path: str) -> str:
        return self.aliases.get(path, path)

    def kind(self, path: str) -> T.DataType | None:
        """Type at a dotted path; an array of objects on the way makes it an array of the leaf's type."""
        at: T.DataType = self.fields
        many = False
        for part in self.column(path).split("."):
            while isinstance(at, T.ArrayType):
                at, many = at.elementType, True
            if isinstance(at, T.MapType):
                at = at.valueType
                continue
            if not isinstance(at, T.StructType) or part not in at.names:
                return None
            at = at[part].dataType
        return T.ArrayType(at) if many and not isinstance(at, T.ArrayType) else at


#: What scripts may call.
SCRIPT_FUNCTIONS = set(
    "abs acos aggregate any_value array array_contains array_distinct array_except array_intersect array_join array_max array_min array_position array_size array_sort array_union "
    "asin atan atan2 avg bround cardinality case cast ceil ceiling char_length coalesce concat concat_ws contains cos count date date_add date_diff date_format date_sub date_trunc "
    "datediff day dayofmonth dayofweek dayofyear decimal degrees double element_at endswith exists exp extract filter float floor forall from_unixtime get greatest hash hour hypot if "
    "ifnull in initcap instr int interval isnan isnotnull isnull lcase least left length levenshtein ln locate log log10 log1p log2 lower lpad ltrim make_date map map_keys map_values "
    "max md5 min minute mod month months_between named_struct nanvl not nullif nvl nvl2 or and pi pmod pow power quarter radians regexp_extract regexp_like regexp_replace repeat replace "
    "reverse right rint round rpad rtrim second sha2 sign signum sin size slice soundex split sqrt startswith string struct substr substring sum tan timestamp to_date to_timestamp "
    "transform translate trim trunc try_cast try_divide ucase unix_timestamp upper weekday when then else xxhash64 year zip_with".split()
)


def sql_literal(v: Any) -> str:
    """A parameter's value within an expression; texts as bytes in hexadecimal, so that no character in them means anything."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return repr(v) if not isinstance(v, float) or abs(v) < float("inf") else f"double('{v}')"
    if isinstance(v, (list, tuple)):
        return f"array({', '.join(map(sql_literal, v))})"
    return f"string(unhex('{str(v).encode().hex()}'))"


@dataclass
class Compiler:
    schema: Schema
    stats: Mapping[str, TextStats] = field(default_factory=dict)
    inner: Column | None = None  # the element that a nested query looks at
    inner_path: str = ""
    flags: Mapping[int, str] = field(default_factory=dict)  # columns that say whether a joined query matches

    # -- fields -----------------------------------------------------------------------------------------------

    def col(self, path: str) -> Column:
        if path == "_id":
            return F.col(f"`{self.schema.id_column}`")
        if path in ("_index", "_score"):
            return F.col(path)
        if self.schema.kind(path) is None and self.inner is None:
            return F.lit(None).cast("string")
        path = self.schema.column(path)
        if self.inner is not None and path.startswith(self.inner_path + "."):
            out = self.inner
            for part in path[len(self.inner_path) + 1 :].split("."):
                out = out[part]
            return out
        first, *rest = path.split(".")
        out = F.col(f"`{first}`")
        for part in rest:
            out = out[part]
        return out

    def is_array(self, path: str) -> bool:
        if self.inner is not None and path.startswith(self.inner_path + "."):
            return False
        return isinstance(self.schema.kind(path), T.ArrayType)

    def element(self, path: str) -> T.DataType | None:
        kind = self.schema.kind(path)
        return kind.elementType if isinstance(kind, T.ArrayType) else kind

    def any_of(self, path: str, test: Callable[[Column], Column]) -> Column:
        """A value's test; of many values, any one's."""
        c = self.col(path)
        return F.exists(c, test) if self.is_array(path) else test(c)

    def tokens(self, path: str) -> Column:
        a = self.schema.analyzer(path)
        c = self.col(path)
        if a is None:
            return c if self.is_array(path) else F.array(c.cast("string"))
        made = F.flatten(F.transform(c, a)) if self.is_array(path) else a(c)
        if self.inner is None and path in self.schema.stored:  # documents that were written without tokens have their text
            return F.coalesce(F.col(f"`{self.schema.stored[path]}`"), made)
        return made

    def terms(self, path: str, text: Any) -> list[str]:
        """Tokens of a query's text, by the field's analyzer for searching."""
        name = self.schema.search_analyzers.get(path) or self.schema.analyzers.get(path)
        if name is None:
            return [str(text)]
        own = (self.schema.settings or {}).get("analyzer", {}).get(name)
        plain = python_tokens(str(text), name) if own is None else None
        if plain is not None:
            return plain
        from pyspark.sql import SparkSession

        row = SparkSession.getActiveSession().range(1).select(REGISTRY.resolve(name, self.schema.settings)(F.lit(str(text))).alias("t")).first()
        return list(row.t or [])

    def value(self, path: str, v: Any) -> Column:
        kind = self.element(path)
        if path == "_id":
            return F.lit(v)
        return F.lit(v).cast(kind) if kind is not None and not isinstance(kind, (T.StructType, T.MapType)) else F.lit(v)

    # -- queries ----------------------------------------------------------------------------------------------

    def compile(self, q: Any) -> Part:
        if isinstance(q, (list, tuple)):
            return self.bool({"must": list(q)})
        if not isinstance(q, Mapping) or len(q) != 1:
            raise ValueError(f"a query is a hash with one key: {q!r}")
        kind, body = next(iter(q.items()))
        method = getattr(self, f"q_{kind}", None)
        if kind == "bool":
            return self.bool(body)
        if method is None:
            raise ValueError(f"unknown query: {kind}")
        return method(body)

    def constant(self, test: Column, boost: float = ONE, sure: bool = False) -> Part:
        return Part(test, F.lit(float(boost)), sure)

    def bool(self, body: Mapping) -> Part:
        must, should = ([self.compile(q) for q in as_list(body.get(k))] for k in ("must", "should"))
        kept, never = ([self.compile(q) for q in as_list(body.get(k))] for k in ("filter", "must_not"))
        need = body.get("minimum_should_match")
        least = least_matches(need, len(should)) if need is not None else int(bool(should) and not must and not kept)
        tests = [p.test for p in must + kept] + [~p.certain() for p in never]
        if should and least == 1:
            tests.append(reduce(lambda a, b: a | b, [p.certain() for p in should]))
        elif should and least:
            tests.append(total([F.when(p.certain(), 1).otherwise(0) for p in should]) >= least)
        scores = [p.score for p in must] + [F.when(p.certain(), p.score).otherwise(ZERO) for p in should]
        boost = float(body.get("boost", 1))
        score = total(scores) if scores else F.lit(ZERO)
        return Part(every(tests), score * boost if boost != 1 else score, all(p.sure for p in must + kept))

    def q_match_all(self, body: Mapping) -> Part:
        return self.constant(F.lit(True), body.get("boost", 1), True)

    def q_match_none(self, body: Mapping) -> Part:
        return self.constant(F.lit(False), 1, True)

    @staticmethod
    def single(body: Mapping) -> tuple[str, Any]:
        entries = [(k, v) for k, v in body.items() if k not in ("boost", "_name")]
        if len(entries) != 1:
            raise ValueError(f"one field is needed: {body!r}")
        return entries[0]

    def q_term(self, body: Mapping) -> Part:
        path, v = self.single(body)
        boost = body.get("boost", 1)
        if isinstance(v, Mapping):
            v, boost = v["value"], v.get("boost", boost)
        if path in self.schema.analyzers:
            return self.scored(path, [str(v)], F.array_contains(self.tokens(path), str(v)), boost)
        return self.constant(self.any_of(path, lambda c: c.eqNullSafe(self.value(path, v)) if v is None else c == self.value(path, v)), boost)

    def q_terms(self, body: Mapping) -> Part:
        path, vs = self.single(body)
        vs = as_list(vs)
        boost = body.get("boost", 1)
        if not vs:
            return self.constant(F.lit(False), boost, True)
        if path in self.schema.analyzers:
            return self.constant(F.arrays_overlap(self.tokens(path), F.array(*[F.lit(str(v)) for v in vs])), boost)
        return self.constant(self.any_of(path, lambda c: c.isin([self.value(path, v) for v in vs])), boost)

    def q_range(self, body: Mapping) -> Part:
        path, limits = self.single(body)
        tests = {"gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "from": lambda c, v: c >= v, "to": lambda c, v: c <= v}
        known = [(tests[k], self.value(path, v)) for k, v in limits.items() if k in tests and v is not None]
        if not known:
            return self.q_exists({"field": path})
        return self.constant(self.any_of(path, lambda c: every([t(c, v) for t, v in known])), limits.get("boost", 1))

    def q_ids(self, body: Mapping) -> Part:
        values = [str(v) for v in as_list(body.get("values", body.get("value")))]
        if not values:
            return self.constant(F.lit(False), 1, True)
        own = self.schema.fields[self.schema.id_column].dataType if self.schema.id_column in self.schema.fields.names else T.StringType()
        if isinstance(own, (T.LongType, T.IntegerType)):  # compared as numbers, so that the scan can skip row groups
            values = [int(v) for v in values if re.fullmatch(r"-?\d+", v)]
            return self.constant(self.col("_id").isin(values) if values else F.lit(False))
        return self.constant(self.col("_id").cast("string").isin(values))

    def q_exists(self, body: Mapping) -> Part:
        path = body["field"]
        c = self.col(path)
        if self.is_array(path):
            return self.constant(F.coalesce(F.exists(c, lambda x: x.isNotNull()), F.lit(False)), body.get("boost", 1), True)
        return self.constant(c.isNotNull(), body.get("boost", 1), True)

    def q_missing(self, body: Mapping) -> Part:
        return self.constant(~self.q_exists(body).certain(), 1, True)

    # -- full text --------------------------------------------------------------------------------------------

    def scored(self, path: str, terms: list[str], test: Column, boost: float = 1) -> Part:
        stats = self.stats.get(path)
        if path not in self.schema.analyzers or stats is None:
            return self.constant(test, boost)
        t = self.tokens(path)
        return Part(test, total([bm25(t, x, stats) for x in terms]) * float(boost))

    def q_match(self, body: Mapping) -> Part:
        path, spec = self.single(body)
        spec = spec if isinstance(spec, Mapping) else {"query": spec}
        terms = self.terms(path, spec["query"])
        boost = spec.get("boost", 1)
        if path not in self.schema.analyzers:
            return self.q_term({path: {"value": spec["query"], "boost": boost}})
        if not terms:
            return self.constant(F.lit(spec.get("zero_terms_query") == "all"), boost, True)
        t = self.tokens(path)
        distinct = list(dict.fromkeys(terms))
        if spec.get("fuzziness") not in (None, 0, "0"):
            near = [self.near(t, x, spec["fuzziness"], spec.get("prefix_length", 0)) for x in distinct]
            need = len(near) if str(spec.get("operator", "or")).lower() == "and" else least_matches(spec.get("minimum_should_match", 1), len(near)) or 1
            return self.constant(total([F.when(n, 1).otherwise(0) for n in near]) >= need, boost)
        holds = [F.array_contains(t, x) for x in distinct]
        if str(spec.get("operator", "or")).lower() == "and":
            test = every(holds)
        elif (need := least_matches(spec.get("minimum_should_match", 1), len(terms)) or 1) > 1:
            test = total([F.when(h, 1).otherwise(0) for h in holds]) >= min(need, len(distinct))
        else:
            test = F.arrays_overlap(t, F.array(*[F.lit(x) for x in distinct]))
        return self.scored(path, terms, test, boost)

    @staticmethod
    def edits(term: str, fuzziness: Any) -> int:
        if str(fuzziness).upper() == "AUTO":
            return 0 if len(term) < 3 else 1 if len(term) < 6 else 2
        return int(fuzziness)

    def near(self, tokens: Column, term: str, fuzziness: Any, prefix: int = 0) -> Column:
        most = self.edits(term, fuzziness)
        return F.exists(tokens, lambda t: (F.levenshtein(t, F.lit(term)) <= most) & t.startswith(term[:prefix]))

    def q_match_phrase(self, body: Mapping) -> Part:
        path, spec = self.single(body)
        spec = spec if isinstance(spec, Mapping) else {"query": spec}
        terms, slop = self.terms(path, spec["query"]), int(spec.get("slop", 0))
        if not terms:
            return self.constant(F.lit(False), 1, True)
        t = self.tokens(path)
        if slop and len(terms) > 1:
            test = self.sloppy(t, terms, slop)
        else:
            # a token can't hold the separator, so a run of tokens is a substring of them joined
            joined = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
            test = joined.contains(" " + " ".join(terms) + " ")
        return self.scored(path, terms, every([F.array_contains(t, x) for x in dict.fromkeys(terms)]) & test, spec.get("boost", 1))

    @staticmethod
    def sloppy(tokens: Column, terms: list[str], slop: int) -> Column:
        """Whether the terms can be put into the phrase by `slop` moves of one place in all (two terms swap by two).

        With a term's position less its place in the phrase as its shift, the shifts may differ by `slop` at most. A term that
        the phrase holds several times needs as many positions.
        """
        at = lambda i, x: F.filter(F.transform(tokens, lambda t, p: F.when(t == x, p - i)), lambda p: p.isNotNull())
        shifts = [at(i, x) for i, x in enumerate(terms)]
        back = lambda i: lambda y: y + i
        within = lambda d, x: F.filter(d, lambda y: (y >= x) & (y <= x + slop))

        def holds(x: Column) -> Column:
            tests = [F.size(within(d, x)) > 0 for d in shifts]
            for term in {t for t in terms if terms.count(t) > 1}:
                places = [F.transform(within(shifts[i], x), back(i)) for i, t in enumerate(terms) if t == term]
                tests.append(F.size(F.array_distinct(F.concat(*places))) >= len(places))
            return every(tests)

        return F.exists(F.array_distinct(F.concat(*shifts)), holds)

    def q_match_phrase_prefix(self, body: Mapping) -> Part:
        path, spec = self.single(body)
        terms = self.terms(path, spec["query"] if isinstance(spec, Mapping) else spec)
        joined = F.concat(F.lit(" "), F.array_join(self.tokens(path), " "))
        return self.constant(joined.contains(" " + " ".join(terms)) if terms else F.lit(False))

    def q_multi_match(self, body: Mapping) -> Part:
        parts = []
        for f in as_list(body["fields"]):
            path, _, boost = f.partition("^")
            spec = {k: body[k] for k in ("query", "operator", "minimum_should_match", "fuzziness", "prefix_length") if k in body}
            kind = "match_phrase" if body.get("type") in ("phrase", "phrase_prefix") else "match"
            parts.append(self.compile({kind: {path: {**spec, "boost": float(boost or 1)}}}))
        scores = [F.when(p.certain(), p.score).otherwise(ZERO) for p in parts]
        best = total(scores) if body.get("type") == "most_fields" else self.best(scores, float(body.get("tie_breaker", 0)))
        return Part(reduce(lambda a, b: a | b, [p.certain() for p in parts]), best, True)

    @staticmethod
    def best(scores: list[Column], tie: float) -> Column:
        top = F.greatest(*scores) if len(scores) > 1 else scores[0]
        return top + tie * (total(scores) - top) if tie else top

    def text_leaf(self, path: str, test: Callable[[Column], Column]) -> Column:
        return F.exists(self.tokens(path), test) if path in self.schema.analyzers else self.any_of(path, lambda c: test(c.cast("string")))

    def q_prefix(self, body: Mapping) -> Part:
        path, v = self.single(body)
        v, low = (v["value"], v.get("case_insensitive")) if isinstance(v, Mapping) else (v, False)
        return self.constant(self.text_leaf(path, lambda c: F.lower(c).startswith(v.lower()) if low else c.startswith(v)), 1)

    def q_wildcard(self, body: Mapping) -> Part:
        path, v = self.single(body)
        v, low = (v.get("value", v.get("wildcard")), v.get("case_insensitive")) if isinstance(v, Mapping) else (v, False)
        pattern = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in v)
        return self.constant(self.text_leaf(path, lambda c: c.rlike(f"(?s{'iu' if low else ''})^(?:{pattern})$")))

    def q_regexp(self, body: Mapping) -> Part:
        path, v = self.single(body)
        v = v["value"] if isinstance(v, Mapping) else v
        return self.constant(self.text_leaf(path, lambda c: c.rlike(f"(?s)^(?:{v})$")))

    def q_fuzzy(self, body: Mapping) -> Part:
        path, v = self.single(body)
        v = v if isinstance(v, Mapping) else {"value": v}
        term, most = str(v["value"]), self.edits(str(v["value"]), v.get("fuzziness", "AUTO"))
        start = term[: int(v.get("prefix_length", 0))]
        return self.constant(self.text_leaf(path, lambda c: (F.levenshtein(c, F.lit(term)) <= most) & c.startswith(start)))

    def q_query_string(self, body: Mapping) -> Part:
        fields = as_list(body.get("fields") or body.get("default_field") or list(self.schema.analyzers))
        if not fields:
            raise BadQuery("no field to search in")
        return self.compile(parse(body["query"], [f.partition("^")[0] for f in fields], body.get("default_operator", "or")))

    def q_simple_query_string(self, body: Mapping) -> Part:
        try:
            return self.q_query_string(body)
        except BadQuery:  # this form never fails
            fields = [f.partition("^")[0] for f in as_list(body.get("fields") or list(self.schema.analyzers))]
            return self.q_multi_match({"query": body["query"], "fields": fields})

    # -- compounds --------------------------------------------------------------------------------------------

    def q_constant_score(self, body: Mapping) -> Part:
        p = self.compile(body["filter"])
        return Part(p.test, F.lit(float(body.get("boost", 1))), p.sure)

    def q_dis_max(self, body: Mapping) -> Part:
        parts = [self.compile(q) for q in body["queries"]]
        scores = [F.when(p.certain(), p.score).otherwise(ZERO) for p in parts]
        return Part(reduce(lambda a, b: a | b, [p.certain() for p in parts]), self.best(scores, float(body.get("tie_breaker", 0))) * float(body.get("boost", 1)), True)

    def q_boosting(self, body: Mapping) -> Part:
        up, down = self.compile(body["positive"]), self.compile(body["negative"])
        return Part(up.test, up.score * F.when(down.certain(), float(body["negative_boost"])).otherwise(ONE), up.sure)

    def q_function_score(self, body: Mapping) -> Part:
        p = self.compile(body.get("query", {"match_all": {}}))
        functions = as_list(body.get("functions")) or [{k: body[k] for k in ("weight", "field_value_factor", "script_score") if k in body}]
        applied = []
        for f in functions:
            v = F.lit(float(f.get("weight", 1)))
            if "field_value_factor" in f:
                spec = f["field_value_factor"]
                raw = F.coalesce(self.col(spec["field"]).cast("double"), F.lit(float(spec.get("missing", 1)))) * float(spec.get("factor", 1))
                shape = {"none": lambda x: x, "log1p": lambda x: F.log10(x + 1), "ln1p": F.log1p, "sqrt": F.sqrt, "square": lambda x: x * x, "log": F.log10, "ln": F.log, "reciprocal": lambda x: 1 / x}
                v = v * shape[spec.get("modifier", "none")](raw)
            if "script_score" in f:
                v = v * self.script(f["script_score"]["script"]).cast("double")
            applied.append((self.compile(f["filter"]).certain() if "filter" in f else F.lit(True), v))
        mode = body.get("score_mode", "multiply")
        on = [F.when(t, v) for t, v in applied]
        count = total([F.when(t, 1).otherwise(0) for t, _ in applied])
        if mode in ("sum", "avg"):
            s = total([F.coalesce(x, F.lit(ZERO)) for x in on])
            s = s / F.greatest(count, F.lit(1)) if mode == "avg" else s
        elif mode in ("max", "min"):
            s = on[0] if len(on) == 1 else (F.greatest if mode == "max" else F.least)(*on)
        elif mode == "first":
            s = F.coalesce(*on)
        else:
            s = reduce(lambda a, b: a * b, [F.coalesce(x, F.lit(ONE)) for x in on])
        s = F.when(count > 0, s).otherwise(ONE)
        how = {"multiply": lambda a, b: a * b, "sum": lambda a, b: a + b, "replace": lambda a, b: b, "avg": lambda a, b: (a + b) / 2, "max": F.greatest, "min": F.least}
        return Part(p.test, how[body.get("boost_mode", "multiply")](p.score, s) * float(body.get("boost", 1)), p.sure)

    def q_nested(self, body: Mapping) -> Part:
        path = body["path"]
        q = body.get("query", body.get("filter"))
        arr = self.col(path)
        test = lambda e: Compiler(self.schema, self.stats, e, path, self.flags).compile(q).certain()
        return self.constant(F.exists(arr, test) if isinstance(self.schema.kind(path), T.ArrayType) else arr.isNotNull() & test(arr))

    def q_has_parent(self, body: Mapping) -> Part:
        return self.flag(body)

    q_has_child = q_parent_id = q_has_parent

    def flag(self, body: Mapping) -> Part:
        if id(body) not in self.flags:
            raise ValueError("this query needs an index with a join field")
        return self.constant(F.col(self.flags[id(body)]).isNotNull(), 1, True)

    def q_geo_distance(self, body: Mapping) -> Part:
        path, p = next((k, v) for k, v in body.items() if k not in ("distance", "distance_type", "boost", "unit"))
        lat, lon = geo.point(p)
        return self.constant(self.any_of(path, lambda c: geo.distance(c, lat, lon) <= geo.metres(body["distance"])))

    def q_geo_bounding_box(self, body: Mapping) -> Part:
        path, box = self.single(body)
        if "top_left" in box:
            (top, left), (bottom, right) = geo.point(box["top_left"]), geo.point(box["bottom_right"])
        else:
            top, left, bottom, right = (float(box[k]) for k in ("top", "left", "bottom", "right"))
        return self.constant(self.any_of(path, lambda c: geo.in_box(c, top, left, bottom, right)))

    def q_geo_polygon(self, body: Mapping) -> Part:
        path, shape = self.single(body)
        corners = [geo.point(p) for p in shape["points"]]
        return self.constant(self.any_of(path, lambda c: geo.in_polygon(c, corners)))

    def script(self, script: Any) -> Column:
        """A Spark SQL expression over the document's columns; `params.x` stands for parameters."""
        source, params = (script.get("source", script.get("inline")), script.get("params", {})) if isinstance(script, Mapping) else (script, {})
        source = re.sub(r"doc\['([\w.]+)'\]\.value", r"\1", source)
        bare = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", "''", source)
        called = {f.lower() for f in re.findall(r"([A-Za-z_][\w.]*)\s*\(", bare)}
        if ";" in bare or (unknown := called - SCRIPT_FUNCTIONS):
            raise ValueError(f"this expression isn't allowed: {source if ';' in bare else sorted(unknown)}")
        names = "|".join(re.escape(k) for k in sorted(params, key=len, reverse=True))
        if names:  # all at once, so that a value that looks like a parameter stays as it is
            source = re.sub(rf"params\.({names})\b", lambda m: sql_literal(params[m[1]]), source)
        return F.expr(source)

    def q_script(self, body: Mapping) -> Part:
        return self.constant(self.script(body["script"]).cast("boolean"))

    def q_type(self, body: Mapping) -> Part:
        return self.constant(F.col("_index") == body["value"], 1, True)

    def q_indices(self, body: Mapping) -> Part:
        here = F.col("_index").isin(as_list(body.get("indices", body.get("index"))))
        other = body.get("no_match_query", "all")
        rest = {"all": F.lit(True), "none": F.lit(False)}.get(other) if isinstance(other, str) else self.compile(other).certain()
        return self.constant((here & self.compile(body["query"]).certain()) | (~here & rest), 1, True)

    def q_limit(self, body: Mapping) -> Part:
        return self.constant(F.lit(True), 1, True)

    # -- what a request needs before it can be compiled -------------------------------------------------------

    def wanted_terms(self, q: Any, into: dict[str, set[str]]) -> None:
        """Terms by text field whose statistics the score needs."""
        if isinstance(q, (list, tuple)):
            for x in q:
                self.wanted_terms(x, into)
        elif isinstance(q, Mapping):
            for kind, body in q.items():
                if kind in ("match", "match_phrase", "term") and isinstance(body, Mapping):
                    path, spec = self.single(body)
                    text = spec.get("query", spec.get("value")) if isinstance(spec, Mapping) else spec
                    if path in self.schema.analyzers:
                        into.setdefault(path, set()).update([str(text)] if kind == "term" else self.terms(path, text))
                elif kind == "multi_match":
                    for f in as_list(body["fields"]):
                        path = f.partition("^")[0]
                        if path in self.schema.analyzers:
                            into.setdefault(path, set()).update(self.terms(path, body["query"]))
                elif kind in ("query_string", "simple_query_string"):
                    fields = [f.partition("^")[0] for f in as_list(body.get("fields") or body.get("default_field") or list(self.schema.analyzers))]
                    try:
                        self.wanted_terms(parse(body["query"], fields, body.get("default_operator", "or")), into)
                    except BadQuery:
                        if kind == "query_string":
                            raise
                        self.wanted_terms({"multi_match": {"query": body["query"], "fields": fields}}, into)
                elif kind not in ("filter", "must_not", "nested"):
                    self.wanted_terms(body, into)


def joined_queries(q: Any) -> list[tuple[str, Mapping]]:
    """Parent/child queries anywhere in a query."""
    if isinstance(q, (list, tuple)):
        return [x for i in q for x in joined_queries(i)]
    if not isinstance(q, Mapping):
        return []
    return [x for k, v in q.items() for x in ([(k, v)] if k in ("has_parent", "has_child", "parent_id") and isinstance(v, Mapping) else joined_queries(v))]
