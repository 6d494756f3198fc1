"""Named query plans: each registered query and its independent SQL check."""
