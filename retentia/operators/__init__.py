"""Table operators: population, scorecard, features, segments, evaluation, prep, models, explain."""
