"""Plans: the steps that both languages compile to, their checks, identities and executor."""
