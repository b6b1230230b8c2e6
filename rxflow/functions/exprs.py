"""Column expressions for reactions, molecules, identifiers and sets; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published atom-level tokenizer pattern, with one group.
TOKEN_PATTERN = r"(\[[^\]]+]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\|/|:|~|@|\?|>|\*|\$|%[0-9]{2}|[0-9])"
# The enzyme classes.
EC_CLASS_NAMES = {
    "1": "1 Oxidoreductases",
    "2": "2 Transferases",
    "3": "3 Hydrolases",
    "4": "4 Lyases",
    "5": "5 Isomerases",
    "6": "6 Ligases",
    "7": "7 Translocases",
}
# The databases whose references are accessions, and the quality threshold.
ACCESSION_DBS = ("uniprot", "swissprot")
MIN_QUALITY = 0.3


# ---- reactions and molecule sets ------------------------------------------------------


def molecules(side: Column) -> Column:
    """The non-empty molecules of a dot-joined side."""
    return F.filter(F.split(side, r"\."), lambda m: m != "")


def split_reaction(reaction: Column) -> Column:
    """``struct<reactants, products>``; null unless there is exactly one ``>>`` with a molecule on either side."""
    sides = F.split(reaction, ">>")
    left, right = molecules(F.get(sides, F.lit(0))), molecules(F.get(sides, F.lit(1)))
    good = (F.size(sides) == 2) & (F.size(left) > 0) & (F.size(right) > 0)
    return F.when(good, F.struct(left.alias("reactants"), right.alias("products")))


def all_or_null(items: Column) -> Column:
    """The array, or null if one of its items is null."""
    return F.when(~F.exists(items, lambda x: x.isNull()), items)


def join_molecules(items: Column) -> Column:
    """Sorted and dot-joined; repeated molecules stay."""
    return F.array_join(F.array_sort(items), ".")


def reaction_key(reactants: Column, products: Column) -> Column:
    return F.concat(reactants, F.lit(">>"), products)


def undirected_key(reactants: Column, products: Column) -> Column:
    """The same for a reaction and its reverse."""
    return F.concat(F.least(reactants, products), F.lit("|"), F.greatest(reactants, products))


def molecule_set(side: Column, canonical=lambda m: m) -> Column:
    """Distinct canonical molecules of a side; those without a canonical form are dropped."""
    return F.array_distinct(F.filter(F.transform(molecules(side), canonical), lambda m: m.isNotNull()))


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays without repeats hold the same items."""
    return F.array_sort(a) == F.array_sort(b)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.when(both > 0, both))


def tanimoto(a: Column, b: Column) -> Column:
    """Of two arrays of distinct on-bits; null if either is null. Two empty ones are alike to 0."""
    both = F.size(F.array_intersect(a, b))
    return F.when(a.isNotNull() & b.isNotNull(), both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


# ---- tokens and k-mers ----------------------------------------------------------------


def atom_tokens(smiles: Column) -> Column:
    """Atom-level tokens; characters that are none are skipped."""
    return F.regexp_extract_all(smiles, F.lit(TOKEN_PATTERN), F.lit(1))


def tokens_to_text(smiles: Column) -> Column:
    return F.array_join(atom_tokens(smiles), " ")


def text_to_smiles(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def reconstructs(smiles: Column) -> Column:
    """Whether the tokens make up the whole string."""
    return F.array_join(atom_tokens(smiles), "") == smiles


def kmers(sequence: Column, k: int) -> Column:
    """Distinct substrings of length k; the whole sequence if it is shorter; none if it is empty."""
    if k <= 0:
        raise ValueError(f"k must be positive, not {k}")
    n = F.length(sequence)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(sequence, i, F.lit(k)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def word_shingles(text: Column, k: int) -> Column:
    """Distinct runs of k words; the whole text if it has fewer words; none without words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    n = F.size(words)
    every = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, F.lit(k)), " "))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(every))


# ---- cleaning and classes -------------------------------------------------------------


def direction(source: Column) -> Column:
    return F.when(F.coalesce(source, F.lit("")).contains("reversed"), "reversed").otherwise("forward")


def clean(value: Column) -> Column:
    """Trimmed; null, blank and the placeholder ``/`` become empty."""
    text = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"^\s+|\s+$", "")
    return F.when(text == "/", "").otherwise(text)


def is_human(tax_id: Column, species: Column) -> Column:
    """By the taxonomy number (a numeric column), or by name."""
    number = F.coalesce(F.floor(tax_id.try_cast("double")) == 9606, F.lit(False))
    return number | F.lower(clean(species)).contains("homo sapiens")


def organism_class(tax_id: Column, species: Column, coarse: Column) -> Column:
    kind = F.lower(clean(coarse))
    return F.when(is_human(tax_id, species), "human").when(kind.isin("animal", "plant", "microorganism"), kind).otherwise("")


def good_quality(quality: Column, steps: Column, least: float = MIN_QUALITY) -> Column:
    """A single step of sufficient quality; NaN and null fail."""
    return F.coalesce((quality >= least) & ~F.isnan(quality) & (steps == "single"), F.lit(False))


def ec_class(ec: Column) -> Column:
    """What stands before the first dot, if it is a class, else ``other``."""
    head = F.trim(F.substring_index(F.coalesce(ec, F.lit("")), ".", 1))
    return F.when(head.isin(*EC_CLASS_NAMES), head).otherwise("other")


def ec_class_name(ec: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in EC_CLASS_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, ec_class(ec)), F.lit("other"))


# ---- text -----------------------------------------------------------------------------


def matches(needle: str, *fields: Column) -> Column:
    """Case-insensitive search in fields joined by spaces; nulls count as empty."""
    joined = F.concat_ws(" ", *(F.coalesce(f, F.lit("")) for f in fields))
    return F.contains(F.lower(joined), F.lower(F.lit(needle)))


def shortened(text: Column, most: int = 42) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("…"))).otherwise(text)


def escape_xml(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def slug(text: Column) -> Column:
    # The characters that a name keeps, and the name of nothing.
    out = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.when(out == "", "run").otherwise(out)


def readable(number: Column) -> Column:
    """With thousands separators; two decimals unless it is whole."""
    n = number.cast("double")
    return F.when(n == F.floor(n), F.format_number(n, 0)).otherwise(F.format_number(n, 2))


def model_input(reactants: Column) -> Column:
    """A sequence-to-sequence prompt: the reactants and an empty block of reagents."""
    # The marks of the blocks.
    return F.concat(F.lit("REACTANT:"), reactants, F.lit("REAGENT:"))


# ---- vectors --------------------------------------------------------------------------


def mean_pool(rows: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is not 0, per component; at least one counts as divisor."""
    first = F.get(rows, F.lit(0))
    zero = F.transform(first, lambda x: F.lit(0.0))
    total = F.aggregate(
        F.zip_with(rows, mask, lambda r, m: F.transform(r, lambda x: x.cast("double") * m.cast("double"))),
        zero,
        lambda s, r: F.zip_with(s, r, lambda a, b: a + b),
    )
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m.cast("double")), F.lit(1.0))
    return F.transform(total, lambda x: x / count)


def padded(items: Column, size: int, value: int) -> Column:
    """The array with a value added up to a size; label padding uses -100."""
    return F.concat(items, F.array_repeat(F.lit(value), F.greatest(F.lit(size) - F.size(items), F.lit(0))))


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct runs of n words, as 64-bit hashes; of fewer words the whole sequence; none without words or text. Words stand between blanks, tabs and line ends."""
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")

    def runs(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))
        return F.when(F.size(w) > 0, F.array_distinct(every)).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(words), runs), F.lit(0))  # words are bound by the outer function, so a text is split once


def cell(value: Column) -> Column:
    """A number as reports show it, with four digits; a dash for null."""
    return F.when(value.isNull(), "—").otherwise(F.format_string("%.4f", value.cast("double")))
