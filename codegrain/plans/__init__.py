"""Plans that put operators together: training sets and evaluations."""
