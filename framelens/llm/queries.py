"""All queries of the text operators: importing this module registers them."""

from importlib import import_module

MODULES = ("op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13")


def registered():
    import corpus_pipeline

    for module in MODULES:
        import_module(f"framelens.llm.{module}")
    from framelens.llm.registry import QUERIES, SQL

    queries = {**QUERIES, "pipeline": corpus_pipeline.run}
    return queries, SQL if corpus_pipeline.ORACLE_SQL is None else {**SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
