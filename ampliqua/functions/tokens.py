"""Column expressions over tokens: one token for each reference position of a read.

`=A` match, `=N` unknown, `-A` deletion, `*AG` substitution, `+T|+T|=G` insertion before an anchor; lower-case bases are
inverted. All of them are built-in expressions, so they stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

N_TAG = "^(=[Nn]|[+].*[|]=[Nn])$"


def operator(token: Column) -> Column:
    return F.substring(token, 1, 1)


def is_lower(token: Column) -> Column:
    """All its letters are lower-case, and it has one: the token lies in an inversion."""
    return (F.lower(token) == token) & token.rlike("[a-z]")


def has_lower(token: Column) -> Column:
    return token.rlike("[a-z]")


def is_n_tag(token: Column) -> Column:
    """The reference base is unknown: `=N`, or an insertion before it."""
    return token.rlike(N_TAG)


def is_unknown(token: Column) -> Column:
    return F.upper(token) == "=N"


def match_score(midsv: Column) -> Column:
    """Minus the characters `+`, `-`, `*` and the lower-case letters of a read's joined tokens; 0 is a perfect match."""
    return -(F.regexp_count(midsv, F.lit("[+]")) + F.regexp_count(midsv, F.lit("-")) + F.regexp_count(midsv, F.lit("[*]")) + F.regexp_count(midsv, F.lit("[a-z]")))


def nm_tag(tokens: Column) -> Column:
    """A letter a token: N for unknown, M for the others."""
    return F.array_join(F.transform(tokens, lambda t: F.when(is_n_tag(t), "N").otherwise("M")), "")


def n_ratio(nm: Column) -> Column:
    return F.when(F.length(nm) > 0, F.regexp_count(nm, F.lit("N")) / F.length(nm)).otherwise(0.0)


def longest_n_run(nm: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(nm, F.lit("N+"), F.lit(0)), lambda x: F.length(x))), F.lit(0))


def n_percent(tokens: Column) -> Column:
    """Unknown tokens in percent of all."""
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, is_n_tag)) * 100 / F.size(tokens)).otherwise(0.0)


def internal_n_to_deletion(tokens: Column, reference: Column) -> Column:
    """Unknown tokens between known ones become deletions of the reference base; leading and trailing ones stay."""
    known = F.filter(F.transform(tokens, lambda t, i: F.when(~is_n_tag(t), i)), lambda i: i.isNotNull())
    first, last = F.array_min(known), F.array_max(known)
    fix = lambda t, i: F.when(is_n_tag(t) & (i > first) & (i < last), F.concat(F.lit("-"), F.substring(reference, i + 1, F.lit(1)))).otherwise(t)
    return F.transform(tokens, fix)


def n_boundaries(tokens: Column) -> Column:
    """Struct of the last position of the leading and the first of the trailing unknown run."""
    known = F.filter(F.transform(tokens, lambda t, i: F.when(~is_n_tag(t), i)), lambda i: i.isNotNull())
    return F.struct((F.coalesce(F.array_min(known), F.size(tokens)) - 1).alias("left"), (F.coalesce(F.array_max(known), F.lit(-1)) + 1).alias("right"))


def is_reverse(flag: Column) -> Column:
    return flag.bitwiseAND(F.lit(16)) != 0


def strand(flag: Column) -> Column:
    return F.when(is_reverse(flag), "-").otherwise("+")


def anchor(token: Column) -> Column:
    """The token that an insertion stands before; the token itself if it is none."""
    return F.element_at(F.split(token, "[|]"), -1)


def inserted(token: Column) -> Column:
    """Bases of an insertion, upper-case; '' for other tokens."""
    parts = F.filter(F.split(token, "[|]"), lambda p: p.startswith("+"))
    return F.upper(F.array_join(F.transform(parts, lambda p: F.substring(p, F.lit(2), F.length(p))), ""))


def insertion_size(token: Column) -> Column:
    return F.regexp_count(token, F.lit("[|]"))


def compress_insertion(token: Column, keep_size: bool = False) -> Column:
    """`+I` (or `+` and the size) and the anchor in place of an insertion."""
    head = F.concat(F.lit("+"), insertion_size(token).cast("string")) if keep_size else F.lit("+I")
    return F.when(token.startswith("+") & ~token.startswith("+I"), F.concat(head, anchor(token))).otherwise(token)


def reference_base(token: Column) -> Column:
    """The reference base that a token stands for; N where it names none."""
    body = F.when(token.startswith("+"), F.coalesce(F.try_element_at(F.filter(F.split(token, "[|]"), lambda p: ~p.startswith("+")), F.lit(-1)), F.lit("=N"))).otherwise(token)
    return F.when(F.length(body) < 2, "N").otherwise(F.upper(F.substring(body, 2, 1)))


def dna_only(sequence: Column) -> Column:
    return F.regexp_replace(F.upper(sequence), "[^ACGTN]", "")


def mask_neighbour(token: Column, kinds: Column) -> Column:
    """The token if its operator is among the kinds of its position, else `@`."""
    return F.when(F.array_contains(kinds, operator(token)), token).otherwise("@")


def split_parts(tokens: Column) -> Column:
    """Insertions split into their parts."""
    return F.flatten(F.transform(tokens, lambda t: F.split(t, "[|]")))


def standard_case(token: Column) -> Column:
    """Bodies of matches in upper case, of all else in lower case."""
    body = F.substring(token, F.lit(2), F.length(token))
    return F.concat(operator(token), F.when(operator(token) == "=", F.upper(body)).otherwise(F.lower(body)))


def merge_by_operator(tokens: Column) -> Column:
    """Neighbours of one operator as one token; substitutions keep their mark: `*ag*tc`."""
    def step(acc: Column, t: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(last, F.when(operator(t) == "*", t).otherwise(F.substring(t, F.lit(2), F.length(t))))
        same = F.coalesce(operator(last) == operator(t), F.lit(False))
        return F.when(same, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(t)))

    return F.aggregate(tokens, F.array().cast("array<string>"), step)


def cs_tag(tokens: Column) -> Column:
    """The long cs tag of the tokens."""
    return F.array_join(F.transform(merge_by_operator(split_parts(tokens)), standard_case), "")


def complement(tokens: Column) -> Column:
    """Bases of every token complemented, in place."""
    return F.transform(tokens, lambda t: F.translate(t, "ACGTacgt", "TGCAtgca"))


def plain_sequence(tokens: Column) -> Column:
    """The read's sequence, inverted bases in lower case and not yet turned: deletions give nothing."""
    def bases(t: Column) -> Column:
        tail = anchor(t)
        last = F.when(tail.startswith("-"), "").otherwise(F.substring(tail, -1, 1))
        ins = F.array_join(F.transform(F.filter(F.split(t, "[|]"), lambda p: p.startswith("+")), lambda p: F.substring(p, F.lit(2), F.lit(1))), "")
        return F.when(t.startswith("+"), F.concat(ins, last)).otherwise(last)

    return F.array_join(F.transform(tokens, bases), "")


def turn_inversions(sequence: Column) -> Column:
    """Each run of lower-case bases reverse-complemented in place."""
    runs = F.regexp_extract_all(sequence, F.lit("[a-z]+|[^a-z]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[a-z]"), F.reverse(F.translate(r, "acgt", "tgca"))).otherwise(r)), "")


def sequence_of(tokens: Column) -> Column:
    return turn_inversions(plain_sequence(tokens))
