"""Column expressions for peptide sequences, identifiers and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Monoisotopic residue masses, water and proton.
RESIDUES = {
    "G": 57.021464, "A": 71.037114, "S": 87.032028, "P": 97.052764, "V": 99.068414, "T": 101.047670, "C": 103.009185,
    "L": 113.084064, "I": 113.084064, "N": 114.042927, "D": 115.026943, "Q": 128.058578, "K": 128.094963, "E": 129.042593,
    "M": 131.040485, "H": 137.058912, "F": 147.068414, "R": 156.101111, "Y": 163.063329, "W": 186.079313,
}
MODIFICATIONS = {"UNIMOD:1": 42.010565, "UNIMOD:4": 57.021464, "UNIMOD:21": 79.966331, "UNIMOD:35": 15.994915, "UNIMOD:7": 0.984016}
WATER, PROTON = 18.0105647, 1.00727646677
#: Kyte-Doolittle hydropathy.
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}
TOKEN = r"\[[^\]]*\]|[A-Z]"


def strip_modifications(seq: Column) -> Column:
    """Without (...), [...] and hyphens."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(seq, r"\([^)]*\)", ""), r"\[[^\]]*\]", ""), "-", "")


def plain_residues(seq: Column, fold: bool = False) -> Column:
    """Bracketed parts removed, A-Z kept; fold turns I into L."""
    out = F.regexp_replace(F.regexp_replace(seq, r"\[[^\]]*\]|\([^)]*\)", ""), "[^A-Z]", "")
    return F.translate(out, "I", "L") if fold else out


def registry_key(peptide: Column) -> Column:
    """Every I becomes L, never the reverse."""
    return F.translate(peptide, "I", "L")


def tokens(seq: Column) -> Column:
    return F.regexp_extract_all(seq, F.lit(f"({TOKEN})"), F.lit(1))


def canonical(seq: Column) -> Column:
    """I becomes L in residues, not inside brackets."""
    return F.array_join(F.transform(tokens(seq), lambda t: F.when(t == "I", F.lit("L")).otherwise(t)), "")


def has_glyco_code(seq: Column) -> Column:
    return F.coalesce(seq, F.lit("")).rlike(r"\[[Ii][Nn]:\d+\]")


def is_unmodified(seq: Column) -> Column:
    return seq.rlike("^[A-Z]+$")


def has_bare(seq: Column, residue: str) -> Column:
    """The residue occurs without a modification after it."""
    return seq.rlike(rf"{residue}(?![\[(])")


def label_bare(seq: Column, residue: str, label: str) -> Column:
    return F.regexp_replace(seq, rf"{residue}(?![\[(])", f"{residue}{label}")


def modification_tokens(seq: Column) -> Column:
    return F.regexp_extract_all(seq, F.lit(r"(\[[^\]]*\])"), F.lit(1))


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])


def neutral_mass(seq: Column) -> Column:
    """Sum of residue and modification masses and water; null for an unknown token."""
    table = _map(RESIDUES | {f"[{k}]": v for k, v in MODIFICATIONS.items()})
    return F.aggregate(tokens(seq), F.lit(WATER), lambda a, t: a + F.try_element_at(table, t))


def precursor_mz(seq: Column, charge: Column) -> Column:
    return neutral_mass(seq) / charge + F.lit(PROTON)


def ppm_error(value: Column, reference: Column) -> Column:
    """Absolute; infinite for a reference of 0."""
    return F.when(reference == 0, F.lit(float("inf"))).otherwise(F.abs(value - reference) / reference * 1e6)


def hydrophobicity(seq: Column) -> Column:
    """Mean hydropathy of the residues, unknown ones 0; NaN for none."""
    table = _map(HYDROPATHY)
    letters = F.filter(F.split(seq, ""), lambda x: x != "")
    total = F.aggregate(letters, F.lit(0.0), lambda a, x: a + F.coalesce(F.try_element_at(table, x), F.lit(0.0)))
    return F.when(F.size(letters) == 0, F.lit(float("nan"))).otherwise(total / F.size(letters))


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance between token lists, each token one character by its place among both lists' distinct tokens, of which there may be 55,000."""
    known = F.array_distinct(F.concat(a, b))
    # code points 256 up to the surrogates, as UTF-16
    sign = lambda x: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, x) + 255), 4, "0")), "UTF-16BE")
    spell = lambda t: F.array_join(F.transform(t, sign), "")
    return F.levenshtein(spell(a), spell(b))


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - token_distance(a, b) / longest)


def distance_bin(distance: Column, bins: list[int]) -> Column:
    """d=<bin> for an exact bin, d>=<last> for all else."""
    out = F.lit(f"d>={bins[-1]}")
    for b in bins[:-1]:
        out = F.when(distance == b, F.lit(f"d={b}")).otherwise(out)
    return out


def usi(project: Column, run: Column, scan: Column, seq: Column | None = None, charge: Column | None = None) -> Column:
    base = F.concat_ws(":", F.lit("mzspec"), project, run, F.lit("scan"), scan)
    if seq is None:
        return base
    tail = F.when(charge.isNotNull(), F.concat_ws("/", seq, charge.cast("string"))).otherwise(seq)
    return F.when(seq.isNotNull(), F.concat_ws(":", base, tail)).otherwise(base)


def usi_part(value: Column, i: int) -> Column:
    """Part i (from 0) between colons, null when there are fewer."""
    return F.try_element_at(F.split(value, ":"), F.lit(i + 1))


def accession(path: Column) -> Column:
    """PXD before MSV."""
    found = lambda p: F.nullif(F.regexp_extract(path, p, 0), F.lit(""))
    return F.coalesce(found(r"PXD\d+"), found(r"MSV\d+"))


def stem(path: Column) -> Column:
    """File name without folders, known extensions and a shard suffix _dddd-dddd."""
    name = F.element_at(F.split(path, "/"), -1)
    name = F.regexp_replace(name, r"\.(parquet|ipc|csv)$", "")
    return F.regexp_replace(F.regexp_replace(name, r"_\d{4}-\d{4}$", ""), r"(?i)\.mzml$", "")


def shard(path: Column) -> tuple[Column, Column]:
    """(number, total) of a shard suffix, null without one."""
    part = lambda i: F.regexp_extract(path, r"_(\d{4})-(\d{4})\.parquet$", i).try_cast("int")
    return part(1), part(2)


def isolation_from_header(header: Column) -> Column:
    """The number before @ in a scan header."""
    return F.regexp_extract(header, r"\b(\d+\.\d+)@", 1).try_cast("double")


def ion_type(annotation: Column) -> Column:
    return F.nullif(F.regexp_extract(annotation, "^([abcxyzp])", 1), F.lit(""))


def ion_position(annotation: Column) -> Column:
    return F.regexp_extract(annotation, r"^[abcxyz](\d+)", 1).try_cast("int")


def ion_charge(annotation: Column) -> Column:
    """From ^n, else the number of plus signs, at least 1."""
    hat = F.regexp_extract(annotation, r"\^(\d+)", 1).try_cast("int")
    plus = F.length(annotation) - F.length(F.translate(annotation, "+", ""))
    return F.coalesce(hat, F.greatest(plus, F.lit(1)))


def replace_all(seq: Column, pairs) -> Column:
    """Literal replacements, one after the other."""
    for old, new in pairs:
        seq = F.replace(seq, F.lit(old), F.lit(new))
    return seq


#: Names of modifications by UNIMOD id.
TYPES = {"1": "Acetyl", "4": "Carbamidomethyl", "7": "Deamidated", "21": "Phospho", "35": "Oxidation"}


def modification_types(seq: Column) -> Column:
    """Names of a sequence's modifications, sorted and joined by " + "; Unmodified for none."""
    names = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    found = F.transform(F.regexp_extract_all(seq, F.lit(r"UNIMOD:(\d+)"), F.lit(1)), lambda i: F.coalesce(F.try_element_at(names, i), F.lit("Other")))
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.array_distinct(found)), " + "), F.lit("")), F.lit("Unmodified"))


def has_phospho(seq: Column) -> Column:
    return F.coalesce(seq, F.lit("")).rlike(r"(?i)unimod:21(?!\d)|phospho|\(ph\)")


def has_glyco_text(seq: Column) -> Column:
    return F.coalesce(seq, F.lit("")).rlike(r"(?i)hexnac|glyco|\(gly\)|\(glc\)")


def has_deamidated_n(seq: Column) -> Column:
    return F.coalesce(seq, F.lit("")).rlike(r"(?i)N[\[(]unimod:7[\])]|N\[115(?:\.\d+)?\]")
