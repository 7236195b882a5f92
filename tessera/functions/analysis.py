"""Analyzers: text to an array of tokens, all as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Step = Callable[[Column], Column]


def standard_tokens(c: Column) -> Column:
    """Runs of letters and digits."""
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+)"), 1)


def whitespace_tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def keyword_token(c: Column) -> Column:
    return F.when(c.isNotNull(), F.array(c))


def ngram_tokens(least: int, most: int) -> Step:
    def of_size(c: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(c) - n + 1)
        return F.when(F.length(c) >= n, F.transform(starts, lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    def grams(c: Column) -> Column:
        by_size = [of_size(c, n) for n in range(least, most + 1)]
        return F.when(c.isNotNull(), F.concat(*by_size) if len(by_size) > 1 else by_size[0])

    return grams


def edge_ngram_tokens(least: int, most: int) -> Step:
    def grams(c: Column) -> Column:
        size = F.least(F.length(c), F.lit(most))
        return F.when(size >= least, F.transform(F.sequence(F.lit(least), size), lambda n: F.substring(c, F.lit(1), n))).otherwise(F.when(c.isNotNull(), F.array().cast("array<string>")))

    return grams


def each(step: Step) -> Step:
    return lambda tokens: F.transform(tokens, step)


def lower_tokens(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def fold_tokens(tokens: Column) -> Column:
    """Accents off: the marks of letters with one of the usual accents."""
    plain = "aaaaaaceeeeiiiinooooouuuuyy"
    return F.transform(tokens, lambda t: F.translate(F.lower(t), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", plain))


def stop_tokens(words: list[str]) -> Step:
    return lambda tokens: F.filter(tokens, lambda t: ~t.isin(words))


def length_tokens(least: int, most: int) -> Step:
    return lambda tokens: F.filter(tokens, lambda t: F.length(t).between(least, most))


def synonym_tokens(table: Mapping[str, list[str]]) -> Step:
    """Each token stays; its synonyms follow it."""
    entries = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return lambda tokens: F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.coalesce(entries[t], F.array().cast("array<string>")))))


def phonetic_tokens(tokens: Column) -> Column:
    return F.transform(tokens, F.soundex)


VOWELS = "AEIOU"
#: The rules of NYSIIS for a word's start and its end, in this order.
NYSIIS_START = (("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS"))
NYSIIS_END = (("EE", "Y"), ("IE", "Y"), ("DT", "D"), ("RT", "D"), ("RD", "D"), ("NT", "D"), ("ND", "D"))


def nysiis(word: str) -> str:
    """The key of a word by the New York State Identification and Intelligence System."""
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    if not w:
        return ""
    w = next((new + w[len(old) :] for old, new in NYSIIS_START if w.startswith(old)), w)
    w = next((w[: -len(old)] + new for old, new in NYSIIS_END if w.endswith(old)), w)
    key, i = w[0], 1
    w = list(w)
    while i < len(w):
        c, rest = w[i], "".join(w[i : i + 3])
        if rest.startswith("EV"):
            w[i : i + 2] = "AF"
        elif c in VOWELS:
            w[i] = "A"
        elif c in "QZM":
            w[i] = {"Q": "G", "Z": "S", "M": "N"}[c]
        elif c == "K":
            w[i] = "N" if rest.startswith("KN") else "C"
        elif rest == "SCH":
            w[i : i + 3] = "SSS"
        elif rest.startswith("PH"):
            w[i : i + 2] = "FF"
        elif c == "H" and (w[i - 1] not in VOWELS or i + 1 < len(w) and w[i + 1] not in VOWELS) or c == "W" and w[i - 1] in VOWELS:
            w[i] = w[i - 1]
        if w[i] != key[-1]:
            key += w[i]
        i += 1
    if key.endswith("S") and len(key) > 1:
        key = key[:-1]
    if key.endswith("AY"):
        key = key[:-2] + "Y"
    return key[:-1] if key.endswith("A") and len(key) > 1 else key


def nysiis_tokens(tokens: Column) -> Column:
    """No built-in expression does this: Arrow batches of whole token arrays, each distinct token once a batch."""

    @F.pandas_udf("array<string>")
    def encode(batches: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return batches.map(lambda ts: None if ts is None else [t if t is None else known.get(t) or known.setdefault(t, nysiis(t)) for t in ts])

    return encode(tokens)


def phonetic(encoder: str) -> Step:
    known = {"soundex": phonetic_tokens, "nysiis": nysiis_tokens}
    if encoder not in known:
        raise ValueError(f"unknown phonetic encoder {encoder}; there are {sorted(known)}")
    return known[encoder]


def pattern_replace(pattern: str, by: str) -> Step:
    return lambda c: F.regexp_replace(c, pattern, by)


@dataclass(frozen=True)
class Analyzer:
    """Character filters, then a tokenizer, then token filters."""

    tokenizer: Step = standard_tokens
    filters: tuple[Step, ...] = (lower_tokens,)
    char_filters: tuple[Step, ...] = ()

    def __call__(self, c: Column) -> Column:
        for f in self.char_filters:
            c = f(c)
        c = self.tokenizer(c)
        for f in self.filters:
            c = f(c)
        return c


@dataclass
class Registry:
    """Named parts and analyzers, shared by indexes; an index's own settings come first."""

    analyzers: dict[str, Analyzer] = field(default_factory=dict)
    tokenizers: dict[str, Step] = field(default_factory=dict)
    filters: dict[str, Step] = field(default_factory=dict)
    char_filters: dict[str, Step] = field(default_factory=dict)

    def resolve(self, name: str, settings: Mapping | None = None) -> Analyzer:
        """settings: {'analyzer': {name: {'tokenizer':, 'filter': [...], 'char_filter': [...]}}, 'tokenizer': {...}, ...}."""
        own = (settings or {}).get("analyzer", {}).get(name)
        if own is None:
            if name not in self.analyzers:
                raise KeyError(f"no analyzer is named {name}")
            return self.analyzers[name]
        if isinstance(own, Analyzer):
            return own
        part = lambda kind, n: build(kind, n, (settings or {}).get(kind, {}).get(n), getattr(self, f"{kind}s"))
        listed = lambda x: [x] if isinstance(x, str) else list(x or [])
        return Analyzer(
            part("tokenizer", own.get("tokenizer", "standard")),
            tuple(part("filter", n) for n in listed(own.get("filter"))),
            tuple(part("char_filter", n) for n in listed(own.get("char_filter"))),
        )


def build(kind: str, name: str, spec: Mapping | Step | None, shared: Mapping[str, Step]) -> Step:
    """A part from its settings, or the shared one of that name."""
    if spec is None:
        if name not in shared:
            raise KeyError(f"no {kind} is named {name}")
        return shared[name]
    if callable(spec):
        return spec
    made = {
        "ngram": lambda: ngram_tokens(int(spec.get("min_gram", 1)), int(spec.get("max_gram", 2))),
        "nGram": lambda: ngram_tokens(int(spec.get("min_gram", 1)), int(spec.get("max_gram", 2))),
        "edge_ngram": lambda: edge_ngram_tokens(int(spec.get("min_gram", 1)), int(spec.get("max_gram", 2))),
        "pattern_replace": lambda: pattern_replace(spec["pattern"], spec.get("replacement", "")),
        "synonym": lambda: synonym_tokens(_synonyms(spec.get("synonyms", []))),
        "stop": lambda: stop_tokens(list(spec.get("stopwords", []))),
        "length": lambda: length_tokens(int(spec.get("min", 0)), int(spec.get("max", 1 << 30))),
        "phonetic": lambda: phonetic(str(spec.get("encoder", "soundex")).lower()),
        "lowercase": lambda: lower_tokens,
    }.get(spec.get("type"))
    if made is None:
        raise ValueError(f"{kind} {name}: unknown type {spec.get('type')}")
    return made()


def _synonyms(lines: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for line in lines:
        if "=>" in line:
            left, right = ([w.strip() for w in side.split(",")] for side in line.split("=>"))
            for w in left:
                out.setdefault(w, []).extend(right)
        else:
            group = [w.strip() for w in line.split(",")]
            for w in group:
                out.setdefault(w, []).extend(x for x in group if x != w)
    return out


REGISTRY = Registry(
    analyzers={
        "standard": Analyzer(),
        "simple": Analyzer(lambda c: F.regexp_extract_all(c, F.lit(r"(\p{L}+)"), 1)),
        "whitespace": Analyzer(whitespace_tokens, ()),
        "keyword": Analyzer(keyword_token, ()),
        "lowercase_keyword": Analyzer(keyword_token),
        "folding": Analyzer(standard_tokens, (fold_tokens,)),
    },
    tokenizers={"standard": standard_tokens, "whitespace": whitespace_tokens, "keyword": keyword_token},
    filters={"lowercase": lower_tokens, "icu_folding": fold_tokens, "asciifolding": fold_tokens, "phonetic": phonetic_tokens},
)


def python_tokens(text: str, name: str = "standard") -> list[str] | None:
    """Tokens of a query's text without a job, for the analyzers that are plain; None for others."""
    import regex

    if name == "standard":
        return [t.lower() for t in regex.findall(r"[\p{L}\p{N}]+", text)]
    if name == "whitespace":
        return text.split()
    if name == "keyword":
        return [text]
    if name == "lowercase_keyword":
        return [text.lower()]
    return None
