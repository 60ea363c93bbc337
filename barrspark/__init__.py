"""Haplotype-resolved allele-specific expression of the X chromosome, on Spark DataFrames."""
