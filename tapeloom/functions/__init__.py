"""Column-level building blocks: cleaning, typing, scaling, labelling and predicates."""
