"""Lexical and identity functions as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values that hashes and profiles hold.
INPUT_VERSION = "text-title-heading_path-filename-v1"
TOKENIZER_VERSION = "regex-v1"
CHUNKER_VERSION = "markdown-text-v1"
#: Fields in their order, with their BM25 weights.
WEIGHTS = {"text": 1.0, "title": 6.0, "heading_path": 4.0, "filename": 2.0}

TOKEN = r"[\p{L}\p{N}_.+#/-]+"
EDGES = "_-/"
#: Between the sub-tokens that matching compares.
_GAP = r"[^\p{L}\p{N}\p{M}\p{Co}]+"


def _accents() -> tuple[str, str]:
    """Letters that are a base letter with marks, and their base letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    # beyond U+024F letters of several marks keep them
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and all(unicodedata.combining(m) for m in b[1:]) and (len(b) == 2 or ord(a) < 0x250)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _accents()


def _folds() -> tuple[str, str, dict[str, str]]:
    """What case folding does to lower-case letters: those that become one letter, these, and those that become several."""
    low = [c for c in map(chr, range(0x80, 0x10000)) if len(c.lower()) == 1 and not 0xD800 <= ord(c) < 0xE000]
    made = {c.lower(): c.lower().casefold() for c in low if c.lower().casefold() != c.lower()}
    one = {a: b for a, b in made.items() if len(b) == 1}
    return "".join(one), "".join(one.values()), {a: b for a, b in made.items() if len(b) > 1 and a != "ß"}


_FOLDED, _FOLDS_TO, _SPELLED_OUT = _folds()


def fold(text: Column) -> Column:
    """Full case folding: lower case, letters of one folding made equal, and sharp s, ligatures and their like spelled out."""
    low = F.lower(text)
    one = F.replace(F.translate(low, _FOLDED, _FOLDS_TO), F.lit("ß"), F.lit("ss"))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _SPELLED_OUT.items()])
    several = F.aggregate(pairs, one, lambda t, p: F.replace(t, p["a"], p["b"]))
    # taking the letters out and comparing costs a tenth of a search for their class
    none = F.translate(low, "".join(_SPELLED_OUT), "") == low
    return F.when(F.length(low) == F.octet_length(low), low).when(none, one).otherwise(several)


def tokens(text: Column) -> Column:
    """Distinct tokens in order of first occurrence."""
    found = F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.btrim(t, F.lit(EDGES))), lambda t: t != ""))


def lexical_text(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def strip_accents(text: Column) -> Column:
    """Letters without their marks; texts without such letters are left as they are."""
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(F.translate(text, _ACCENTED, _PLAIN))


def terms(text: Column) -> Column:
    """The sub-tokens of a text's tokens, as matching compares them; the array of one element binds the tokens, which are found once."""
    return F.get(F.transform(F.array(lexical_text(text)), lambda t: F.filter(F.split(strip_accents(t), _GAP, -1), lambda x: x != "")), F.lit(0))


def phrase_arrays(text: Column) -> Column:
    """A text's distinct tokens, each as the run of sub-tokens that it must match."""
    runs = F.transform(tokens(text), lambda t: F.filter(F.split(strip_accents(t), _GAP, -1), lambda x: x != ""))
    return F.array_distinct(F.filter(runs, lambda r: F.size(r) > 0))


def phrases(query: str) -> list[list[str]]:
    """A query's tokens, each as the run of sub-tokens it must match; computed on the driver."""
    import regex

    out = []
    for t in regex.findall(TOKEN, query.casefold()):
        t = t.strip(EDGES).translate(str.maketrans(_ACCENTED, _PLAIN))
        run = [x for x in regex.split(_GAP, t) if x]
        if run and run not in out:
            out.append(run)
    return out


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file name without its last suffix; names that begin with a dot keep it."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def chunk_id(file_id: Column, generation: Column, ordinal: Column) -> Column:
    return F.concat_ws(":", file_id.cast("string"), generation.cast("string"), ordinal.cast("string"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def retrieval_text(text: Column, title: Column, heading_path: Column, filename: Column) -> Column:
    """What is embedded and reranked: the non-empty parts, a line each."""
    def part(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(label), value))

    return F.array_join(F.array_compact(F.array(part("Title: ", title), part("Heading path: ", heading_path), part("Filename: ", filename), part("Text:\n", text))), "\n")


def input_hash(retrieval: Column, embedding_identity: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{INPUT_VERSION}\0{embedding_identity}\0"), retrieval), 256)


def excerpt(text: Column, size: int = 220) -> Column:
    """White space collapsed, then the first characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, size)


def named_file(filename: Column, path: Column) -> Column:
    """The file name, or the path's last part where it is empty."""
    return F.coalesce(F.nullif(filename, F.lit("")), file_name(path))
