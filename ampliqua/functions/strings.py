"""Column expressions over sequences, names and alignment fields, and the driver's file-name helpers."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def revcomp(sequence: Column, strict: bool = False) -> Column:
    """Reverse complement over ACGTN; strict: an error on any other letter."""
    made = F.reverse(F.translate(sequence, "ACGT", "TGCA"))
    return F.when(sequence.rlike("[^ACGTN]"), F.raise_error(F.lit("not a DNA sequence"))).otherwise(made) if strict else made


def allele_key(name: Column) -> Column:
    return F.md5(name)


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def sanitize(name: Column) -> Column:
    """White space around it off, and each character that file systems or SAM dislike replaced by '-'; an error if nothing is left."""
    trimmed = F.regexp_replace(name, r"^\s+|\s+$", "")
    return F.when(trimmed == "", F.raise_error(F.lit("a name is empty"))).otherwise(F.regexp_replace(trimmed, r'[<>:"/\\|?*\x00-\x1F .]', "-"))


def stem(path: Column) -> Column:
    """Base name up to its first dot."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\..*$", "")


def extension(path: Column) -> Column:
    """All suffixes of the base name."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\..*)$", 1)


def wrap(header: Column, sequence: Column, width: int = 80) -> Column:
    """A FASTA record with lines of that width."""
    return F.concat(F.lit(">"), header, F.lit("\n"), F.regexp_replace(F.regexp_replace(sequence, f"(.{{{width}}})", "$1\n"), "\n$", ""))


def qname(identifier: Column) -> Column:
    return F.regexp_extract(identifier, r"^@?(\S+)", 1)


def fastq_record(identifier: Column, sequence: Column, quality: Column) -> Column:
    return F.concat_ws("\n", identifier, sequence, F.lit("+"), quality)


def cigar_ops(cigar: Column) -> Column:
    """Array of operations, each its length and letter."""
    return F.regexp_extract_all(cigar, F.lit(r"[0-9]+[MIDNSH=X]"), F.lit(0))


def aligned_length(cigar: Column) -> Column:
    """Reference bases that the alignment spans."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"([0-9]+)[MDN=X]"), F.lit(1)), F.lit(0), lambda a, x: a + x.cast("int"))


def trim_soft_clips(cigar: Column, sequence: Column) -> Column:
    head = F.coalesce(F.nullif(F.regexp_extract(cigar, r"^([0-9]+)S", 1), F.lit("")).cast("int"), F.lit(0))
    tail = F.coalesce(F.nullif(F.regexp_extract(cigar, r"([0-9]+)S$", 1), F.lit("")).cast("int"), F.lit(0))
    return F.when(sequence == "*", sequence).otherwise(F.substring(sequence, head + 1, F.length(sequence) - head - tail))


def reverse_flag(flag: Column) -> Column:
    return flag.bitwiseXOR(F.lit(16))


def percent_label(value: Column) -> Column:
    text = F.trim(value.cast("string"))
    return F.when(text.endswith("%"), text).otherwise(F.concat(text, F.lit("%")))


def allele_type_label(allele: Column, kind: Column) -> Column:
    """The allele if intact, 'allele with indels', or the allele and its kind."""
    k = F.lower(F.trim(kind))
    return F.when(k == "intact", allele).when(k == "indels", F.concat(allele, F.lit(" with indels"))).otherwise(F.concat_ws(" ", allele, F.trim(kind)))


def truncate_utf8(value: str, most: int) -> str:
    """The longest beginning of at most that many UTF-8 bytes that ends with a whole character."""
    return value.encode()[:most].decode(errors="ignore")


def report_filename(label: str, suffix: str, sample: str | None = None, most: int = 255) -> str:
    """Sample, label and suffix; too long, of the label only its id and percent, then those cut and a hash."""
    plain = label.replace("|", "_")
    ends = plain.split("_")
    short = f"{ends[0]}_{ends[-1]}" if len(ends) > 1 and ends[0].startswith("allele") and ends[-1].endswith("%") else plain
    head = f"{sample}_" if sample else ""
    for body in (plain, short):
        if len(f"{head}{body}{suffix}".encode()) <= most:
            return f"{head}{body}{suffix}"
    tail = f"_{hashlib.md5(plain.encode()).hexdigest()[:10]}{suffix}"
    return truncate_utf8(f"{head}{short}", most - len(tail.encode())) + tail


def safe_name(name: str) -> str:
    """sanitize() for a single name on the driver."""
    trimmed = str(name).strip()
    if not trimmed:
        raise ValueError("a name is empty")
    return re.sub(r'[<>:"/\\|?*\x00-\x1F .]', "-", trimmed)


def revcomp_text(sequence: str) -> str:
    if set(sequence) - set("ACGTN"):
        raise ValueError("not a DNA sequence")
    return sequence[::-1].translate(str.maketrans("ACGT", "TGCA"))
