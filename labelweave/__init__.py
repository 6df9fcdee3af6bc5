"""labelweave: label denoising over similarity graphs, as Spark DataFrames."""
