"""Training-data operators over web text: budgets, subjects, cutoffs, text
kinds, reading levels, mixtures, encoding, leakage and abusive language.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only when the import succeeds.
"""
