"""Stateful streaming versions of operators. With all input in one go they give the batch operators' results."""
