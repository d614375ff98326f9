"""The registered queries, each with its Spark form and, where SQL can say it, its SQL form."""
