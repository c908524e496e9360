"""fiscalarc: public-finance analytics as plain DataFrame-to-DataFrame functions on Spark."""
