"""The two languages: batch scripts of DATA and PROC steps, and pipelines."""
