"""DataFrame operators: tokens, caps, guarded queries, sessions, request logs."""
