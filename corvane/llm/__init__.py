"""Training-data operators (problems 1 to 10 of TESTDATA.md). Nothing outside this folder imports it."""
