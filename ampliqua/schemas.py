"""Fixed schemas of the engine's tables, and its small records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()  # noqa: E741

READS = _struct(read_ord=L, identifier=S, qname=S, sequence=S, quality=S)
ALLELES = _struct(allele_ord=I, allele=S, allele_key=S, sequence=S)
ALIGNMENTS = _struct(qname=S, flag=I, rname=S, pos=I, mapq=I, cigar=S, rnext=S, pnext=I, tlen=I, seq=S, qual=S, cs=S)
TOKENS = _struct(sample=S, allele=S, read_ord=L, qname=S, strand=S, preset=S, tokens=T.ArrayType(S))
LOCI = _struct(allele=S, pos=I, mut=S)
PROFILE = _struct(allele=S, pos=I, mut=S, n=L, pct=D)
KMER_SCORES = _struct(allele=S, pos=I, kmer=S, score=D)
PWM = _struct(allele=S, label=I, pos=I, tok=S, pct=D)
CONSENSUS = _struct(allele=S, label=I, percent=D, sequence=S, tokens=T.ArrayType(S))
VARIANTS = _struct(chrom=S, pos=I, id=S, ref=S, alt=S, info=T.MapType(S, S))
BED = _struct(chrom=S, start=I, end=I, name=S, chrom_size=I, strand=S)
MANIFEST_REQUIRED, MANIFEST_OPTIONAL = ("sample", "control", "allele", "name"), ("genome", "genome_coordinate", "bed")

#: Kinds of mutation tokens.
MUTATIONS = ("+", "-", "*")


@dataclass(frozen=True)
class ConsensusKey:
    """Names one consensus allele."""

    allele: str
    label: int
    percent: float


@dataclass(frozen=True)
class GenomeCoordinates:
    """Where the amplicon lies: start 0-based, end exclusive."""

    genome: str
    chrom: str
    start: int
    end: int
    strand: str = "+"
    chrom_size: int = 0


@dataclass(frozen=True)
class RunConfig:
    """What a run of one sample needs."""

    name: str
    sample: str
    control: str
    alleles: dict[str, str] = field(default_factory=dict)
    coordinates: GenomeCoordinates | None = None
    no_filter: bool = False
    threads: int = 1
    min_reads: int = 5
    cap_control: int = 10_000
    cap_sample: int = 100_000
    cap_label: int = 1_000
