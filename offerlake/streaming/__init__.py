"""The campaign over a stream of landed offers."""
