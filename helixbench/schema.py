"""Schemas of the canonical tables and the model catalogue."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _d, _i, _l = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


ASSAY_SHEET = _table(
    dms_id=_s, title=_s, author=_s, year=_i, rna_type=_s, rna_type_granular=_s, raw_construct_seq=_s, assay_description=_s, pdb_structure=_s, rfam_link=_s
)
PREDICTIONS = _table(model=_s, dms_id=_s, mutant=_s, score=_d)
LABELS = _table(id=_l, usage=_s, reactivity=_d)
RANGES = _table(sequence_id=_s, sequence=_s, id_min=_l, id_max=_l)
POSITION_PREDICTIONS = _table(sequence=_s, sequence_id=_s, position_id=_i, prediction=_d)
STRUCTURES_BY_SEQUENCE = _table(sequence=_s, method=_s, dotbracket=_s)

#: The score column of each model's prediction files.
SCORE_COLUMNS = {
    "Evo": "scores",
    "GenSLM": "logit_scores",
    "Nucleotide_Transformer": "logit_scores",
    "RNA_FM": "RNA_FM_scores",
    "RiNALMo": "logit_scores",
    "PSSM": "prediction_independent",
    "EVmutation": "prediction_epistatic",
}
#: Models that score sequences, and those that need an alignment.
SEQUENCE_MODELS = ["Evo", "GenSLM", "Nucleotide_Transformer", "RNA_FM", "RiNALMo"]
ALIGNMENT_MODELS = ["PSSM", "EVmutation"]
#: Names of the mutation column, in order of preference.
MUTATION_COLUMNS = ["mutant", "mutation", "Mutation", "mutations"]
#: Columns of older sheet layouts and what they are here.
SHEET_ALIASES = {
    "fitness filename": "dms_id",
    "raw construct sequence": "raw_construct_seq",
    "raw construct sequence (dna)": "raw_construct_seq",
    "first author last name": "author",
    "molecule type": "rna_type",
}
#: Assay types in the order of leaderboards.
RNA_TYPES = ["mRNA", "tRNA", "Aptamer", "Ribozyme"]


def models(with_alignments_only: bool = False) -> list[str]:
    return ALIGNMENT_MODELS if with_alignments_only else SEQUENCE_MODELS
