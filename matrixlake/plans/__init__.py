"""Whole plans built from the operators: conversion, corpora, harmonisation, inspection, management."""
