"""Weather normalisation of air-pollution series on Spark, and corpus operators in ``weathernorm.llm``."""
