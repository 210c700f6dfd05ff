"""Scalar rules as built-in column expressions: null-ish values, identifiers, units, tiers, scores, splits.

Every function takes and returns Columns, stays inside whole-stage code
generation and gives null for null input unless its docstring says otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed values of the formats and rules below.
NULL_TOKENS = ("", "-", "n/a", "na", "nan", "none", "null", "unknown")
INCHIKEY = r"^[A-Z]{14}-[A-Z]{10}-[A-Z]$"
UNIPROT = r"^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})$"
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "κ": "kappa", "λ": "lambda", "μ": "mu", "ω": "omega"}
ACCENTS = ("áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
NM_FACTORS = {"pm": 1e-3, "nm": 1.0, "um": 1e3, "µm": 1e3, "mm": 1e6, "m": 1e9}
NM_CAP = 1e9
CONFIDENCE_TIERS = ((0.06, "sub_weak"), (0.3, "weak"), (0.5, "strong"), (float("inf"), "very_strong"))
HILL_FIRST = ("C", "H")


def is_nullish(c: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """True for null, blank and placeholder strings, whatever their case and outer spaces."""
    return c.isNull() | F.lower(F.trim(c)).isin(*tokens)


def nullish_to_null(c: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    return F.when(~is_nullish(c, tokens), c)


def fill_null(c: Column, default: object, longest: int | None = None) -> Column:
    """A null-ish string's default; longer ones are cut."""
    out = F.coalesce(nullish_to_null(c), F.lit(default))
    return F.substring(out, 1, longest) if longest else out


def inchikey(c: Column) -> Column:
    """Trimmed, upper-case, hyphens put back into 25 letters that lost them; null where it isn't a key or a SYNTH id."""
    raw = F.upper(F.regexp_replace(F.trim(c), r"\s+", ""))
    key = F.when(raw.rlike(r"^[A-Z]{25}$"), F.regexp_replace(raw, r"^(.{14})(.{10})(.)$", "$1-$2-$3")).otherwise(raw)
    return F.when(key.rlike(INCHIKEY) | key.startswith("SYNTH"), key)


def uniprot(c: Column) -> Column:
    """An accession without its isoform, or null."""
    raw = F.regexp_replace(F.upper(F.trim(c)), r"-\d+$", "")
    return F.when(raw.rlike(UNIPROT), raw)


def normal_name(c: Column, *, keep: str = "-/") -> Column:
    """Lower-case, Greek letters spelt, accents dropped, other signs to single spaces, runs of - and / collapsed."""
    out = F.translate(F.lower(c), *ACCENTS)
    for letter, name in GREEK.items():
        out = F.replace(out, F.lit(letter), F.lit(name))
    out = F.regexp_replace(out, rf"[^a-z0-9{keep}]+", " ")
    for sign in keep:
        out = F.regexp_replace(out, rf"{sign}+", sign)
    return F.trim(F.regexp_replace(out, " +", " "))


def disease_id(c: Column) -> Column:
    """Namespace in upper case, one colon: 'omim 123', 'OMIM_123' and 'MIM:123' are OMIM:123; UMLS concepts stay bare."""
    raw = F.upper(F.trim(c))
    space, number = F.regexp_extract(raw, r"^([A-Z]+)[\s:_-]*([0-9]+)$", 1), F.regexp_extract(raw, r"^([A-Z]+)[\s:_-]*([0-9]+)$", 2)
    space = F.when(space == "MIM", "OMIM").otherwise(space)
    return F.when(raw.rlike(r"^C[0-9]{7}$"), raw).when(space != "", F.concat(space, F.lit(":"), number)).otherwise(F.nullif(raw, F.lit("")))


def stitch_cid(c: Column) -> Column:
    """The compound number of CIDm…, CIDs…, CID0… or CID1… ids."""
    return F.nullif(F.regexp_extract(F.trim(c), r"^CID[ms01]?0*([1-9][0-9]*)$", 1), F.lit("")).cast("long")


def organism(c: Column, aliases: dict[str, str]) -> Column:
    """The alias table's name, or the trimmed lower-case name."""
    name = F.lower(F.trim(c))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in sorted(aliases.items()) for x in pair])[name], name)


def hill_formula(c: Column) -> Column:
    """Elements of a molecular formula in Hill order: carbon, hydrogen, then the rest by name; without carbon all by name. Repeats are summed."""
    parts = F.regexp_extract_all(c, F.lit(r"([A-Z][a-z]?[0-9]*)"), 1)
    pairs = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^([A-Z][a-z]?)", 1).alias("e"), F.coalesce(F.nullif(F.regexp_extract(p, r"([0-9]+)$", 1), F.lit("")).cast("int"), F.lit(1)).alias("n")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["e"]))
    carbon = F.array_contains(names, "C")

    def order(e: Column) -> Column:
        return F.when(carbon & (e == "C"), F.lit("0")).when(carbon & (e == "H"), F.lit("1")).otherwise(F.concat(F.lit("2"), e))

    sums = F.transform(names, lambda e: F.struct(order(e).alias("o"), e.alias("e"), F.aggregate(F.filter(pairs, lambda p: p["e"] == e), F.lit(0), lambda a, p: a + p["n"]).alias("n")))
    return F.nullif(F.array_join(F.transform(F.array_sort(sums), lambda s: F.concat(s["e"], F.when(s["n"] > 1, s["n"].cast("string")).otherwise(""))), ""), F.lit(""))


def fuzzy_choice(c: Column, choices: Sequence[str], *, most: int = 3) -> Column:
    """The choice at the least edit distance, `most` at the farthest; ties to the first by name."""
    best = None
    for name in sorted(choices):
        s = F.struct(F.levenshtein(F.lower(F.trim(c)), F.lit(name)).alias("d"), F.lit(name).alias("v"))
        best = s if best is None else F.least(best, s)
    return F.when(best["d"] <= most, best["v"])


def to_nanomolar(value: Column, units: Column, *, cap: float = NM_CAP) -> Column:
    """A concentration in nM by its unit, or from a p-scale (unit 'p', 0 to 14) as 10**(9 - v); cut at cap; null for other units and negatives."""
    unit = F.lower(F.trim(units))
    out = F.when((unit == "p") & value.between(0, 14), F.pow(F.lit(10.0), 9 - value))
    for name, factor in NM_FACTORS.items():
        out = out.when((unit == name) & (value >= 0), value * factor)
    return F.least(out, F.lit(cap))


def is_censored(relation: Column, value_nm: Column, *, cap: float = NM_CAP) -> Column:
    """Whether a value is only a bound: marked by > or <, or cut at cap."""
    return F.coalesce(F.trim(relation).rlike("^[<>]"), F.lit(False)) | (value_nm >= cap)


def log2_expression(value: Column, units: Column) -> Column:
    """log2(v + 1) unless it is in log2 units; negatives give null."""
    return F.when(F.lower(units).contains("log2"), value).when(value >= 0, F.log2(value + 1))


def clean_text(c: Column, *, longest: int = 2000) -> Column:
    """Without control characters and leading labels such as 'FUNCTION:', spaces collapsed, cut."""
    out = F.regexp_replace(c, r"[\x00-\x1F\x7F]+", " ")
    out = F.regexp_replace(F.trim(out), r"^[A-Z ]+:\s*", "")
    return F.substring(F.trim(F.regexp_replace(out, r" +", " ")), 1, longest)


def year_of(c: Column) -> Column:
    """The first year from 1900 to 2099 in a text, or null."""
    return F.nullif(F.regexp_extract(c, r"\b((19|20)[0-9]{2})\b", 1), F.lit("")).cast("int")


def masked(c: Column) -> Column:
    """E-mail addresses and long digit runs replaced by marks."""
    out = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    return F.regexp_replace(out, r"\b[0-9]{9,16}\b", "[number]")


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of values joined by a unit separator; null as an empty string."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def joined_sources(c: Column) -> Column:
    """As an aggregate: distinct non-blank sources, sorted, joined by a pipe."""
    return F.array_join(F.sort_array(F.collect_set(F.nullif(F.trim(c), F.lit("")))), "|")


def tier(score: Column, tiers: Sequence[tuple[float, str]] = CONFIDENCE_TIERS) -> Column:
    """The first tier whose bound is over the score; null outside of 0 to 1."""
    out = None
    for bound, name in tiers:
        out = F.when(score < bound, name) if out is None else out.when(score < bound, name)
    return F.when((score >= 0) & (score <= 1), out)


def weak_escape(score: Column, least: float, weak: float) -> Column:
    """'weak' from least up to weak, 'standard' from there, null below."""
    return F.when(score < least, None).when(score < weak, "weak").when(score >= weak, "standard")


def evidence_class(fdr: Column, value: Column, *, strong: float, moderate: float) -> Column:
    """By the false discovery rate where it tells (under 0.01, 0.05), else by the value's thresholds."""
    return F.when(fdr < 0.01, "strong").when(fdr < 0.05, "moderate").when(value >= strong, "strong").when(value >= moderate, "moderate").otherwise("weak")


def safety_tier(weighted: Column, count: Column, withdrawn: Column) -> Column:
    """The tier of a weighted count of adverse reports; a withdrawn thing has the gravest."""
    return F.when(withdrawn, "red").when((weighted <= 5) & (count <= 3), "green").when((weighted <= 20) & (count <= 10), "yellow").otherwise("red")


def approval(groups: Column, *, negative: Sequence[str] = ("withdrawn", "illicit", "experimental", "investigational")) -> Column:
    """True with the token approved, false with a negative one only, else null; tokens are parted by ; , or |."""
    tokens = F.transform(F.split(F.lower(groups), r"[;,|]"), lambda x: F.trim(x))
    return F.when(F.array_contains(tokens, "approved"), True).when(F.arrays_overlap(tokens, F.array(*[F.lit(x) for x in negative])), False)


def weighted_mean(parts: Sequence[tuple[Column, float]]) -> Column:
    """Mean of the values that are there, by weights over 0; null when none is."""
    parts = [(c, w) for c, w in parts if w > 0]
    total = sum((F.when(c.isNotNull(), c * w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight)


def piecewise(c: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Linear between knots, flat outside of them."""
    out = F.when(c <= knots[0][0], F.lit(float(knots[0][1])))
    for (a, x), (b, y) in zip(knots, knots[1:], strict=False):
        out = out.when(c <= b, x + (c - a) * ((y - x) / (b - a)))
    return F.when(c.isNotNull(), out.otherwise(F.lit(float(knots[-1][1]))))


def unmet_need(rarity: Column, treatments: Column, scale: float) -> Column:
    """0 to 1: the rarer and the less treated, the more."""
    return F.lit(0.6) * rarity + F.lit(0.4) * F.exp(-treatments / scale)


def evidence_score(base: Column, papers: Column, evidence: Column, *, paper_weight: float, paper_cap: float, evidence_weight: float, evidence_cap: float) -> Column:
    """A base and two capped bonuses, cut to 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + F.least(paper_weight * F.log1p(papers), F.lit(paper_cap)) + F.least(evidence * evidence_weight, F.lit(evidence_cap))))


def certainty(p: Column) -> Column:
    """1 - H(p) / ln 2 of a probability."""
    q = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), p))
    return 1 + (q * F.log(q) + (1 - q) * F.log(1 - q)) / math.log(2)


def hash_split(key: Column, *, seed: int = 0, test: float = 0.2, validate: float = 0.0) -> Column:
    """test, validate or train by the leading 32 bits of md5('seed:key')."""
    share = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return F.when(share < test, "test").when(share < test + validate, "validate").otherwise("train")


def temporal_split(year: Column, cutoff: int) -> Column:
    """train up to two years before the cutoff, val up to it, then test; null years have none."""
    return F.when(year <= cutoff - 2, "train").when(year <= cutoff, "val").when(year > cutoff, "test")


def mapped(c: Column, table: dict[str, object], default: object = None) -> Column:
    """A fixed map's value of a key."""
    found = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])[c]
    return F.coalesce(found, F.lit(default)) if default is not None else found


# Words before a tissue's name that say nothing of where it is, in the order in which they are taken off.
TISSUE_STATES = ("primary_", "metastatic_", "recurrent_", "normal_")


def tissue(c: Column, names: dict[str, str] | None = None) -> Column:
    """A tissue's key: lower-case, without what stands in brackets and without words of state before it, white space as _; '' for null.

    With names (key to identifier) the identifier, or null for an unknown tissue.
    """
    key = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    key = F.trim(F.regexp_replace(key, r"\s*\([^)]*\)\s*", " "))
    key = F.regexp_replace(key, r"\s+", "_")
    for state in TISSUE_STATES:
        key = F.regexp_replace(key, f"^{state}", "")
    if names is None:
        return key
    return F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])[key]


def packed(columns: Sequence[str]) -> Column:
    """The columns that aren't null as one JSON text, in the order given; null where all are."""
    some = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(1)) for c in columns])
    return F.when(some.isNotNull(), F.to_json(F.struct(*columns), {"ignoreNullFields": "true"}))


def unpacked(c: Column, schema: str) -> Column:
    """What packed() made, as a struct; fields that aren't there, and texts that aren't JSON, give nulls."""
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})


# Papers and the first year from which evidence is robust, moderate or limited, and the weight of sources that aren't known.
ROBUST_PAPERS, ROBUST_YEAR, MODERATE_PAPERS = 10, 2010, 3
UNKNOWN_SOURCE = 0.3


def paper_ids(c: Column) -> Column:
    """The different numbers in a text parted by ;, in order; an empty array for null."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.transform(F.filter(parts, lambda x: x.rlike(r"^[0-9]{1,18}$")), lambda x: x.cast("long"))))


def evidence_strength(papers: Column, year: Column) -> Column:
    """robust, moderate, limited or unsupported, by how many papers there are and the last one's year (null: not known, which doesn't count against it)."""
    recent = F.coalesce(year >= ROBUST_YEAR, F.lit(True))
    return F.when((papers >= ROBUST_PAPERS) & recent, "robust").when(papers >= MODERATE_PAPERS, "moderate").when(papers >= 1, "limited").otherwise("unsupported")


def source_weighted(score: Column, source: Column, weights: dict[str, float], *, strict: bool = False) -> Column:
    """score times its source's weight; an unknown source weighs UNKNOWN_SOURCE or, strict, raises. Null score or source: null."""
    weight = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])[source]
    known = F.coalesce(weight, F.when(source.isNotNull(), F.raise_error(F.concat(F.lit("unknown source "), source)).cast("double") if strict else F.lit(UNKNOWN_SOURCE)))
    return F.when(score.isNotNull() & source.isNotNull(), score * known)
