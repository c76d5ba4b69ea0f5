"""Writers and the registry of export targets."""
