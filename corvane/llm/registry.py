"""Every query of this package, and its SQL where SQL can express it."""

from corvane.llm import alignment, exact_dedup, line_dedup, media, mixing, ngram_join, ngram_lm, ordered_packing, packing, resampling, token_counts, token_files, toxicity

MODULES = (mixing, ngram_join, packing, line_dedup, toxicity, token_files, media, exact_dedup, ngram_lm, token_counts, resampling, ordered_packing, alignment)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
