"""Plyweave: tensor-codec, sequence and text-corpus analytics as Spark plans."""
