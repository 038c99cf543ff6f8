"""lattiq: volumetric, trajectory and profile analytics expressed in Spark DataFrames."""
