"""Privacy-governed analytics on Spark: policies, tokens, caps, audits, sessions."""
