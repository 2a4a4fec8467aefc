"""Story and evidence analytics as Spark plans: sources, text functions, relational and
stateful operators, retrieval, evaluation and streaming, all on the public DataFrame API."""
