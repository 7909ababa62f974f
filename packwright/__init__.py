"""packwright: knowledge packs, full-text lookup and corpus operators on Spark DataFrames."""
