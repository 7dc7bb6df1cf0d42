"""The SQL dialect: lexer, parser, syntax tree and lowering to Spark SQL."""
