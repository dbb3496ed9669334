"""Requests and the queries built from them."""
