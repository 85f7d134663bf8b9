"""skald: text-corpus analytics and boolean retrieval as Spark DataFrames."""
