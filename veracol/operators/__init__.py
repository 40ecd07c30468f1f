"""DataFrame operators: profile, checks, score, clean and the pieces they share."""
