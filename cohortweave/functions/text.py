"""Identifier and label normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space stripped from identifiers, tokens for a missing value, spellings of labels.
BLANKS = " \t\n\x0b\x0c\r"
NO_CONTIG = ("", "NA", "NAN", ".", "*")
NO_VALUE = ("", "NA", "NaN", "nan", ".")
PLATFORMS = {"450K": "HM450", "450k": "HM450"}
SEXES = {"f": "Female", "female": "Female", "woman": "Female", "m": "Male", "male": "Male", "man": "Male"}
PATTERNS = {
    "sha256": "^[0-9a-f]{64}$",
    "commit": "^[0-9a-f]{7,40}$",
    "path": "^/data(/|$)",
    "source_id": "^[a-z0-9][a-z0-9_]*$",
    "run_id": "^[A-Za-z0-9][A-Za-z0-9._-]*$",
}


def bare(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The table's value for c, null where it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def probe_stem(c: Column) -> Column:
    """A probe name without its design suffix: underscore, two capitals, two digits."""
    return F.regexp_replace(bare(c), "_[A-Z]{2}[0-9]{2}$", "")


def contig_name(c: Column) -> Column:
    """`chr` names: missing tokens are null, the mitochondrion is chrM, names that have the prefix stay."""
    name = bare(c)
    known = F.when(~F.upper(name).isin(*NO_CONTIG), name)
    with_prefix = F.concat(F.lit("chr"), F.when(known == "MT", "M").otherwise(known))
    return F.coalesce(F.when(F.startswith(known, F.lit("chr")), known), with_prefix)


def canonical_key(build: str, chrom: Column, pos: Column) -> Column:
    return F.concat_ws(":", F.lit(build), chrom, pos.cast("string"))


def strip_version(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def donor_of(title: Column) -> Column:
    """What follows the last underscore; a title without one is an error."""
    return F.when(F.instr(title, "_") > 0, F.substring_index(title, "_", -1)).otherwise(F.raise_error(F.concat(F.lit("no donor in "), title)))


def location_key(chrom: Column, pos: Column) -> Column:
    """Contig without prefix and 0-based position; null for an empty or patched contig and for positions below 1."""
    name = F.nullif(F.regexp_replace(bare(chrom), "^chr", ""), F.lit(""))
    usable = ~name.contains("_") & (pos >= 1)
    return F.when(usable, F.concat_ws(":", F.when(name == "M", "MT").otherwise(name), (pos - 1).cast("string")))


def platform_name(c: Column) -> Column:
    """Aliases to one name; unknown names pass through, blank ones are null."""
    name = F.nullif(bare(c), F.lit(""))
    return F.coalesce(lookup(name, PLATFORMS), name)


def sex_label(c: Column) -> Column:
    """One of two labels from six spellings in any case; missing tokens are null and any other word is an error."""
    word = F.nullif(F.lower(bare(c)), F.lit(""))
    missing = word.isNull() | word.isin("na", "nan", "none", "unknown")
    found = lookup(word, SEXES)
    return F.when(~missing, F.coalesce(found, F.raise_error(F.concat(F.lit("unknown sex label "), word))))


def word_label(c: Column) -> Column:
    """Stripped text that does not parse as a number; null otherwise."""
    text = F.nullif(bare(c), F.lit(""))
    return F.when(text.try_cast("double").isNull(), text)


def label_or_control(c: Column, empty_as_control: bool) -> Column:
    """Stripped label; blank and NA are `control` where the family says so, else null."""
    text = bare(c)
    label = F.when(~F.upper(text).isin("", "NA", "NAN"), text)
    return F.coalesce(label, F.lit("control")) if empty_as_control else label


def parse_measure(c: Column) -> Column:
    """NA tokens, NaN in any case and junk to null, numbers to double."""
    number = F.when(~bare(c).isin(*NO_VALUE), bare(c).try_cast("double"))
    return F.when(~F.isnan(number), number)


def strict_measure(c: Column) -> Column:
    """NA tokens and NaN in any case to null, numbers to double; any other text fails the job."""
    number = bare(c).try_cast("double")
    known = bare(c).isNull() | bare(c).isin(*NO_VALUE) | number.isNotNull()
    return F.when(known, parse_measure(c)).otherwise(F.raise_error(F.concat(F.lit("not a number: "), c)).cast("double"))


def first_number(*cols: Column) -> Column:
    """The first column that holds a number; null, NaN and text are passed over."""
    as_number = [F.nanvl(c.cast("string").try_cast("double"), F.lit(None).cast("double")) for c in cols]
    return F.coalesce(*as_number)


def id_list(c: Column, sep: str = ",") -> Column:
    """Delimited ids, stripped, without blanks."""
    return F.filter(F.transform(F.split(c, sep), bare), lambda x: x != "")


def is_series(c: Column) -> Column:
    """Whether an accession is of the series kind, in any case."""
    return F.startswith(F.upper(c), F.lit("GSE"))


def valid(c: Column, kind: str) -> Column:
    """Whether c has the form of PATTERNS[kind]; null has not."""
    return F.coalesce(c.rlike(PATTERNS[kind]), F.lit(False))
