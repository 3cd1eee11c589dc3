"""Ordered rule lists: loading with validation, and their application as Column expressions or broadcast joins.

Rule lists are configuration of bounded size; rules of one list fold into one CASE expression, which stays in generated
code and stops at the first match.
"""

from __future__ import annotations

import fnmatch
import json
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.session import small_side


def _json(path: str | Path, kind: type) -> object:
    got = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(got, kind):
        raise ValueError(f"{path}: expected a JSON {kind.__name__}")
    return got


# --- aliases -----------------------------------------------------------------------------------------------------------


class Aliases:
    """`single`: column -> {lower-cased alias: canonical}; `composite`: [(match, canonical)] in order."""

    def __init__(self, spec: dict):
        self.single: dict[str, dict[str, str]] = {}
        for column, entries in spec.items():
            if column == "composite":
                continue
            if not isinstance(entries, dict):
                raise ValueError(f"aliases of {column} must map canonical values to lists")
            own = self.single.setdefault(column, {})
            for canonical, names in entries.items():
                for name in names:
                    if own.setdefault(name.lower(), canonical) != canonical:
                        raise ValueError(f"{column}: {name!r} stands for both {own[name.lower()]!r} and {canonical!r}")
        self.composite = []
        for rule in spec.get("composite", []):
            if not isinstance(rule, dict) or not rule.get("match") or not rule.get("canonical"):
                raise ValueError("a composite alias needs match and canonical")
            self.composite.append((dict(rule["match"]), dict(rule["canonical"])))

    @classmethod
    def load(cls, path: str | Path) -> Aliases:
        """A missing file is an error: whoever names one means it."""
        return cls(_json(path, dict))

    def apply(self, df: DataFrame) -> DataFrame:
        """Single-column aliases first, then the first composite rule whose columns are all equal; case is ignored."""
        for column, names in self.single.items():
            if column in df.columns and names:
                look = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
                df = df.withColumn(column, F.coalesce(look[F.lower(column)], F.col(column)))
        rules = [(m, c) for m, c in self.composite if set(m) <= set(df.columns)]
        if not rules:
            return df
        hit = F.coalesce(*[F.when(reduce(lambda a, b: a & b, [F.lower(k) == v.lower() for k, v in m.items()]), F.lit(i)) for i, (m, _) in enumerate(rules)])
        df = df.withColumn("_rule", hit)
        for column in {k for _, c in rules for k in c} & set(df.columns):
            new = F.coalesce(*[F.when(F.col("_rule") == i, F.lit(c[column])) for i, (_, c) in enumerate(rules) if column in c], F.col(column))
            df = df.withColumn(column, new)
        return df.drop("_rule")


# --- excludes ----------------------------------------------------------------------------------------------------------


class Excludes:
    """Ordered rules, each {manufacturer, model} (exact, '*' for any) or {filename} (a glob). The first match counts."""

    def __init__(self, rules: list[dict]):
        for i, r in enumerate(rules):
            if not isinstance(r, dict) or set(r) not in ({"manufacturer", "model"}, {"filename"}) or not all(isinstance(v, str) for v in r.values()):
                raise ValueError(f"exclude rule {i} must have manufacturer and model, or filename, as strings")
        self.rules = rules

    @classmethod
    def load(cls, path: str | Path) -> Excludes:
        return cls(_json(path, list)) if Path(path).exists() else cls([])

    def model_rule(self, manufacturer: str = "manufacturer", model: str = "model") -> Column:
        """Number of the first rule that matches, null if none; null values count as ''."""
        one = lambda rule, c: F.lit(True) if rule == "*" else F.coalesce(F.col(c), F.lit("")) == rule
        hits = [F.when(one(r["manufacturer"], manufacturer) & one(r["model"], model), F.lit(i)) for i, r in enumerate(self.rules) if "model" in r]
        return F.coalesce(*hits, F.lit(None).cast("int")) if hits else F.lit(None).cast("int")

    def file_rule(self, name: str = "file_name") -> Column:
        hits = [F.when(F.rlike(F.col(name), F.lit(glob_regex(r["filename"]))), F.lit(i)) for i, r in enumerate(self.rules) if "filename" in r]
        return F.coalesce(*hits, F.lit(None).cast("int")) if hits else F.lit(None).cast("int")

    def keep(self, df: DataFrame) -> DataFrame:
        return df.where(self.model_rule().isNull())

    def keep_files(self, df: DataFrame, name: str = "file_name", skip_prefixes: tuple[str, ...] = ()) -> DataFrame:
        df = df.where(self.file_rule(name).isNull())
        return df.where(~F.rlike(F.col(name), F.lit("^(?:" + "|".join(map(re.escape, skip_prefixes)) + ")"))) if skip_prefixes else df

    def wanted_files(self, names: list[str], skip_prefixes: tuple[str, ...] = ()) -> set[str]:
        """Of a listing's names those that no file rule and no prefix leaves out."""
        rules = [re.compile(glob_regex(r["filename"])) for r in self.rules if "filename" in r]
        return {n for n in names if not n.startswith(skip_prefixes or ("\0",)) and not any(r.search(n) for r in rules)}

    def dead(self, models: DataFrame | None, files: DataFrame | None = None) -> list[int]:
        """Rules that were the first match of no row."""
        seen: set[int] = set()
        for df, rule in ((models, self.model_rule()), (files, self.file_rule())):
            if df is not None:
                seen |= {r[0] for r in df.select(rule.alias("r")).where("r is not null").distinct().collect()}
        return [i for i in range(len(self.rules)) if i not in seen]


def glob_regex(pattern: str) -> str:
    """A shell glob (* ? [seq]) as an anchored regular expression that Java and Python read alike."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (j := pattern.find("]", i + 1)) > 0:
            seq = pattern[i:j].replace("\\", r"\\")
            out.append("[" + ("^" + seq[1:] if seq[0] == "!" else seq) + "]")
            i = j + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + "$"


def glob_match(name: str, pattern: str) -> bool:
    return fnmatch.fnmatchcase(name, pattern)


# --- substitutions -----------------------------------------------------------------------------------------------------


def load_substitutions(path: str | Path) -> dict[str, list[tuple[str, str | None]]]:
    if not Path(path).exists():
        return {}
    out = {}
    for column, rules in _json(path, dict).items():
        out[column] = [(re.compile(r["match"]).pattern, r.get("replace")) for r in rules]
    return out


def substitute(df: DataFrame, rules: dict[str, list[tuple[str, str | None]]]) -> DataFrame:
    """The first pattern found in a value replaces the whole value, by null too. Null values stay null."""
    for column, own in rules.items():
        if column not in df.columns or not own:
            continue
        kind = df.schema[column].dataType
        text = F.col(column).cast("string")
        case = None
        for pattern, new in own:
            value = F.lit(new).cast(kind)
            case = F.when(text.rlike(pattern), value) if case is None else case.when(text.rlike(pattern), value)
        df = df.withColumn(column, case.otherwise(F.col(column)))
    return df


# --- first-match classification ----------------------------------------------------------------------------------------


def load_lut(path: str | Path) -> list[dict]:
    """Ordered rules {element, id_pattern, abbr, tooltip}; one abbreviation must have one tooltip."""
    if not Path(path).exists():
        raise FileNotFoundError(path)
    return check_lut(_json(path, list))


def check_lut(rules: list[dict]) -> list[dict]:
    tips: dict[str, str] = {}
    for i, r in enumerate(rules):
        if r.get("id_pattern"):
            try:
                re.compile(r["id_pattern"])
            except re.error as e:
                raise ValueError(f"rule {i}: {e}") from e
        if tips.setdefault(r["abbr"], r["tooltip"]) != r["tooltip"]:
            raise ValueError(f"{r['abbr']!r} has two tooltips")
    return rules


def first_match(rules: list[dict], tag: Column | str, ident: Column | str) -> Column:
    """Abbreviation of the first rule whose tag list holds `tag` and whose pattern is found in `ident` (any case).

    No pattern matches anything; a null ident counts as ''; no element matches any tag. Null if no rule matches.
    """
    t = F.col(tag) if isinstance(tag, str) else tag
    i = F.coalesce(F.col(ident) if isinstance(ident, str) else ident, F.lit(""))
    case = None
    for r in rules:
        cond = F.lit(True)
        if r.get("element"):
            cond = t.isin(*[x.strip() for x in r["element"].split("|")])
        if r.get("id_pattern"):
            cond = cond & F.rlike(i, F.lit("(?i)" + r["id_pattern"]))
        case = F.when(cond, F.lit(r["abbr"])) if case is None else case.when(cond, F.lit(r["abbr"]))
    return F.lit(None).cast("string") if case is None else case


def first_match_join(df: DataFrame, rules: DataFrame, text: str, pattern: str = "pattern", value: str = "abbr", order: str = "ord", key: tuple[str, ...] = ()) -> DataFrame:
    """The same for rule tables too long for one expression: a broadcast join and the value of the least order per key."""
    hit = df.join(small_side(rules), F.rlike(F.lower(F.col(text)), F.lower(F.col(pattern))), "left")
    return hit.groupBy(*key).agg(F.min_by(value, order).alias(value))


def tooltips(rules: list[dict]) -> dict[str, str]:
    """Abbreviation -> tooltip; the last of equals."""
    return {r["abbr"]: r["tooltip"] for r in rules}


def tooltip_of(cell: Column | str, tips: dict[str, str], mirror: str = "*") -> Column:
    """Tooltip of a cell; a mirrored one has its base's with ' (mirror)'."""
    c = F.col(cell) if isinstance(cell, str) else cell
    look = F.create_map(*[F.lit(x) for kv in tips.items() for x in kv])
    return F.coalesce(look[c], F.when(c.endswith(mirror), F.concat(look[F.regexp_replace(c, re.escape(mirror) + "$", "")], F.lit(" (mirror)"))))


# --- resolutions and link shares ---------------------------------------------------------------------------------------


def load_resolutions(spark: SparkSession, path: str | Path) -> DataFrame:
    """(nk, field, source): which source wins a conflict; anything but 'openmsx' means the other one."""
    rows = [(r["natural_key"], r["field"], "openmsx" if r.get("use") == "openmsx" else "msxorg") for r in _json(path, list)] if Path(path).exists() else []
    return spark.createDataFrame(rows, "nk string, field string, source string")


def load_link_shares(spark: SparkSession, path: str | Path) -> DataFrame:
    """(nk, donor): records that borrow another record's link. A missing file is an error."""
    got = _json(path, dict)
    for k, v in got.items():
        if not isinstance(v, str) or not v or k == v:
            raise ValueError(f"link share {k!r} must name another record")
    return spark.createDataFrame(list(got.items()), "nk string, donor string")
