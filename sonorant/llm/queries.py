"""The queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from sonorant.llm.embeddings import op2_embedding_links
from sonorant.llm.jaccard import op8_jaccard_join
from sonorant.llm.licenses import op10_licenses
from sonorant.llm.merkle import op13_merkle_manifest
from sonorant.llm.neighbours import op11_nearest_neighbours
from sonorant.llm.mixing import op7_mixing
from sonorant.llm.oracle import OP2, OP4, OP8, OP12, OP13
from sonorant.llm.packing import op5_packing
from sonorant.llm.pii import op1_pii
from sonorant.llm.quality import op4_quality
from sonorant.llm.resharding import op9_resharding
from sonorant.llm.secrets import op3_secrets
from sonorant.llm.spelling import op12_spelling_variants
from sonorant.llm.tokens import op6_token_files

QUERIES = {f.__name__: f for f in (op1_pii, op2_embedding_links, op3_secrets, op4_quality, op5_packing, op6_token_files, op7_mixing, op8_jaccard_join, op9_resharding, op10_licenses, op11_nearest_neighbours, op12_spelling_variants, op13_merkle_manifest)}



def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline

ORACLE: dict[str, str] = {"op2_embedding_links": OP2, "op4_quality": OP4, "op8_jaccard_join": OP8, "op12_spelling_variants": OP12, "op13_merkle_manifest": OP13}
