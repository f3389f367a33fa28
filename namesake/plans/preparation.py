"""From a converted register to records and their value tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from namesake.operators import embed, tokens
from namesake.operators.blocking import block_keys
from namesake.operators.factor import factor_gram_vectors
from namesake.operators.features import feature_values
from namesake.session import cut
from namesake.spec import LinkageSpec


@dataclass
class ValueTables:
    """What the later stages know about attribute values.

    ``tokens(value, shape, phon)`` and ``vectors(value, vec)`` cover attribute
    values and name symbols; ``block_vectors(block_key, vec)`` and
    ``block_tokens(block_key, tokens)`` cover block values.
    """

    symbols: DataFrame
    tokens: DataFrame
    vectors: DataFrame
    block_vectors: DataFrame
    block_tokens: DataFrame


def describe_values(
    records: DataFrame,
    spec: LinkageSpec,
    gram_vectors: DataFrame | None = None,
    strokes: DataFrame | None = None,
    variants: DataFrame | None = None,
    phonetic: DataFrame | None = None,
    vector_size: int = 100,
    seed: int = 42,
) -> ValueTables:
    """Tokens and vectors of all distinct values, each written once.

    Without ``gram_vectors(gram, vec)`` they are learnt from the symbols.
    """
    values = cut(feature_values(records, spec))
    symbols = cut(tokens.symbol_tokens(values, strokes, variants, phonetic))
    if gram_vectors is None:
        gram_vectors = factor_gram_vectors(symbols, vector_size, seed)
    value_tokens = cut(tokens.value_tokens(values, symbols))
    symbol_vecs = cut(embed.symbol_vectors(symbols, gram_vectors))
    blocks = cut(block_keys(records, spec))
    return ValueTables(
        symbols=symbols,
        tokens=value_tokens,
        vectors=cut(embed.value_vectors(values, symbol_vecs)),
        block_vectors=cut(embed.block_vectors(blocks, spec.block_cols, symbol_vecs)),
        block_tokens=cut(embed.block_tokens(blocks, spec.block_cols, value_tokens)),
    )
