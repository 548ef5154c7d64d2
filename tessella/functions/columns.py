"""Column expressions: tokens, identifiers, number parsing, units, statuses, uniform draws."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_token(name: Column, ascii_only: bool = False) -> Column:
    """Upper case, letters and digits only."""
    return F.regexp_replace(F.upper(name), "[^A-Z0-9]" if ascii_only else r"[^\p{L}\p{N}]", "")


def is_protein_type(kind: Column) -> Column:
    upper = F.upper(kind)
    return upper.contains("PROTEIN") | upper.contains("ANTIBODY")


def canonical_feature_name(name: Column, kind: Column) -> Column:
    """``protein__NAME`` or ``rna__NAME`` with runs of other characters as one underscore."""
    safe = F.regexp_replace(F.trim(name), r"[^\p{L}\p{N}]+", "_")
    safe = F.regexp_replace(safe, "^_+|_+$", "")
    prefix = F.when(F.coalesce(is_protein_type(kind), F.lit(False)), "protein__").otherwise("rna__")
    return F.concat(prefix, safe)


def packed_cell_id(prefix: Column, suffix: Column) -> Column:
    """Eight hex digits of ``prefix`` written with the letters a to p, a dash and ``suffix``.

    Only a 32-bit unsigned prefix has eight digits; any other, or a negative suffix, has no id (NULL).
    """
    digits = F.lpad(F.lower(F.hex(prefix.cast("long"))), 8, "0")
    packed = F.concat(F.translate(digits, "0123456789abcdef", "abcdefghijklmnop"), F.lit("-"), suffix.cast("string"))
    return F.when((prefix >= 0) & (prefix <= 4294967295) & (suffix >= 0), packed)


def broad_group(group: Column) -> Column:
    """Text after the first underscore, or the whole label."""
    at = F.instr(group, "_")
    return F.when(at > 0, F.substring(group, at + 1, F.length(group))).otherwise(group)


def parse_censored(text: Column) -> Column:
    """Number, or NULL for blank, not-computed, censored (``<``, ``>``) and non-numeric text."""
    plain = F.regexp_replace(F.trim(text), ",", "")
    number = plain.try_cast("double")
    bad = plain.rlike("^[<>]") | F.lower(plain).isin("", "nc", "nan", "none")
    return F.when(~bad & ~F.isnan(number), number)


def convert_units(value: Column) -> Column:
    """1e-7 cm2/s to um2/s, rounded to ten decimals."""
    return F.round(value * 10.0, 10)


def effective_diffusion(diffusion: Column, ecm: Column, caf: Column, beta_ecm: Column, beta_caf: Column) -> Column:
    return diffusion * F.exp(-beta_ecm * ecm - beta_caf * caf)


def failed_conditions(conditions: Mapping[str, Column]) -> Column:
    """Names of the conditions that hold, in declared order."""
    named = [F.when(condition, F.lit(name)) for name, condition in conditions.items()]
    return F.filter(F.array(*named), lambda item: item.isNotNull())


def row_status(reasons: Column, ok: str = "OK", failed: str = "INSUFFICIENT_EVIDENCE") -> Column:
    return F.when(F.size(reasons) == 0, F.lit(ok)).otherwise(F.lit(failed))


def uniform(seed: int | str, *parts: Column) -> Column:
    """Number in [0, 1) that depends only on the seed and the parts, never on partitioning."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def joined(items: Column, separator: str = "|") -> Column:
    return F.array_join(items, separator)
