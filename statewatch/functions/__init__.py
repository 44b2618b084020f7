"""Column functions: arrays, encodings, binary events, bets and likelihoods."""
