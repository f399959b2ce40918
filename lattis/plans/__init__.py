"""From text to a DataFrame: the dialect's parser, its checks, the plan builder and the EXPLAIN renderer."""
